"""File sources: conformance vectors, delimited JSON in text, and tool output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BENCH_RESULT, VECTOR


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """One row for each vector of the multi-line JSON documents at ``path``."""
    return parsed_vectors(spark.read.text(path, wholetext=True))


def parsed_vectors(raw: DataFrame) -> DataFrame:
    """One row for each vector of the JSON documents in column ``value``, with an explicit schema and its raw text."""
    document = T.StructType([T.StructField("test_vectors", T.ArrayType(VECTOR))])
    both = raw.select(
        F.arrays_zip(
            F.from_json("value", document)["test_vectors"].alias("v"),
            F.from_json("value", "test_vectors array<string>")["test_vectors"].alias("raw"),
        ).alias("z")
    )
    return both.select(F.inline("z")).toDF("v", "raw").select("v.*", "raw")


def marked_json(spark: SparkSession, path: str, begin: str = "__BENCH_JSON_BEGIN__", end: str = "__BENCH_JSON_END__") -> DataFrame:
    """Rows of a JSON array that stands between two marks in text files."""
    return marked_rows(spark.read.text(path, wholetext=True), begin, end)


def marked_rows(text: DataFrame, begin: str = "__BENCH_JSON_BEGIN__", end: str = "__BENCH_JSON_END__") -> DataFrame:
    """The same of texts in column ``value``."""
    body = F.regexp_extract("value", f"(?s){begin}(.*?){end}", 1)
    return text.select(F.from_json(body, f"array<struct<{BENCH_RESULT.replace(' ', ':').replace(',:', ',')}>>").alias("rows")).select(F.inline("rows"))


def size_columns(lines: DataFrame, carried: list[str] = ()) -> DataFrame:
    """``name, value`` pairs of a header line and a line of numbers in one text; values that aren't numbers go."""
    cells = lambda at: F.split(_stripped(F.get(F.split("value", "\n"), F.lit(at))), r"\s+")
    pairs = lines.select(*carried, F.inline(F.arrays_zip(cells(0).alias("name"), cells(1).alias("raw"))))
    return pairs.select(*carried, "name", F.expr("try_cast(raw as bigint)").alias("value")).where("value is not null")


def exported_symbols(lines: DataFrame) -> DataFrame:
    """Number of lines that list a defined text symbol."""
    return lines.agg(F.count_if(F.contains("value", F.lit(" T "))).alias("n_symbols"))


def needed_libraries(lines: DataFrame) -> DataFrame:
    """Left sides of ``name => path`` lines, and the loader's own library."""
    left = _stripped(F.split("value", "=>")[0])
    first = F.split(_stripped(F.col("value")), r"\s+")[0]
    return lines.select(F.when(F.contains("value", F.lit("=>")), left).when(F.contains("value", F.lit("linux-vdso")), first).alias("library")).where("library is not null")


def in_memory(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def field_origin(variant: str, field: str, kind: str) -> Column:
    """How a field of a VARIANT column comes by its value: ``given``, ``null``, ``missing``, ``other type``, or ``broken`` where there is no JSON at all."""
    at = F.expr(f"try_variant_get({variant}, '$.{field}')")
    fits = F.expr(f"schema_of_variant(try_variant_get({variant}, '$.{field}'))").isin(_KINDS[kind])
    return (
        F.when(F.col(variant).isNull(), "broken").when(at.isNull(), "missing").when(F.expr(f"is_variant_null(try_variant_get({variant}, '$.{field}'))"), "null")
        .when(fits, "given").otherwise("other type")
    )


#: What ``schema_of_variant`` calls values that count as of a type; other types take the default, without a cast.
_KINDS = {"int": ["BIGINT"], "string": ["STRING"], "boolean": ["BOOLEAN"], "double": ["DOUBLE", "BIGINT", "DECIMAL"]}


def field_or_default(variant: str, field: str, kind: str, default) -> Column:
    """A field of a VARIANT column as ``kind``, or ``default`` where it isn't given as such."""
    value = F.expr(f"try_variant_get({variant}, '$.{field}', '{kind}')")
    return F.coalesce(F.when(field_origin(variant, field, kind) == "given", value), F.lit(default))
