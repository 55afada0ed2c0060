import pytest
from pyspark.sql import functions as F

from beaconfold.functions import codec
from beaconfold.schema import STATUS


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, hexed", [("123", "1203"), ("89A", "890A"), ("", ""), ("ab", "AB")])
def test_lone_digit_is_its_own_byte(spark, text, hexed):
    assert value(spark, codec.to_hex(codec.from_hex(F.lit(text), 10))) == hexed.ljust(20, "0")


def test_long_keys_are_cut(spark):
    assert value(spark, codec.to_hex(codec.from_hex(F.lit("DEADBEEFDEADBEEF0000000000001234"), 10))) == "DEADBEEFDEADBEEF0000"


def test_invalid_digits_give_null(spark):
    assert value(spark, codec.from_hex(F.lit("XY"), 10)) is None


def test_status_round_trip(spark):
    for code, name, message in STATUS:
        assert value(spark, codec.status_code(F.lit(name))) == code
        assert value(spark, codec.status_message(F.lit(code))) == message
    assert value(spark, codec.status_message(F.lit(42))) == "Unknown error"
    assert value(spark, codec.status_code(F.lit("NONE_SUCH"))) is None


def test_small_functions(spark):
    assert value(spark, codec.level_tag(F.lit(2))) == "WARN "
    assert value(spark, codec.level_tag(F.lit(9))) == "?    "
    assert value(spark, codec.line_speed(F.lit(1234))) == 115200
    assert value(spark, codec.or_default(F.lit(0), 30_000)) == 30_000
    assert value(spark, codec.short_number(F.lit(0.05))) == "< 0.1"
    assert value(spark, codec.percent_of(F.lit(3), F.lit(0))) == 0.0
    assert value(spark, codec.text_bar(F.lit(25.0))) == "#####" + "." * 15
    assert value(spark, codec.safe_name(F.lit("TV-DL-001"))) == "TV_DL_001"
    assert value(spark, codec.self_test(F.lit(True), F.lit(True))) == 3
    assert value(spark, codec.backend_status(F.lit("OTHER"))) == -14
    assert value(spark, codec.colour(F.lit(0x0A0B0C))) == "#0A0B0C"
    assert len(value(spark, codec.synthesized_iccid(F.lit("LPA:1$h$m")))) == 20
    assert value(spark, codec.user_level(F.lit("DETAIL"))) == 4
    assert value(spark, codec.missing_activation_code(F.lit("")))


def test_log_line_cuts_milliseconds(spark):
    line = codec.log_line(F.lit("2024-01-02 03:04:05.678901").cast("timestamp"), F.lit(1), F.lit("core"), F.lit("x"), True)
    assert value(spark, line) == "[2024-01-02 03:04:05.678] [ERROR] [core] x"


def test_an_unknown_status_name_ends_the_query(spark):
    names = spark.createDataFrame([("OK",), ("TIMEOUT",), (None,)], "name string")
    assert [r.code for r in names.select(codec.required_status_code(F.col("name")).alias("code")).collect()] == [0, -11, None]
    with pytest.raises(Exception, match="unknown status name: NONE_SUCH"):
        value(spark, codec.required_status_code(F.lit("NONE_SUCH")))


def test_arguments_of_calls(spark):
    yes, no = F.lit(True), F.lit(False)
    status = lambda call, handle=yes, ready=yes, argument=yes, length=F.lit(99): value(spark, codec.argument_status(F.lit(call), handle, ready, argument, length))
    assert [status(n) for n, _, _ in codec.CALLS] == [0] * len(codec.CALLS)
    assert status("list", ready=no) == status("deinit", handle=F.lit(None).cast("boolean")) == status("init", argument=no) == status("none such") == -1
    assert status("init", handle=no) == status("configure", ready=no) == status("pump", argument=no) == 0
    assert status("diagnostics", length=F.lit(1)) == status("diagnostics", length=F.lit(None).cast("int")) == -1


def test_further_forms(spark):
    assert value(spark, codec.lower_hex(F.lit(48879))) == "0xbeef"
    assert value(spark, codec.counted_iccid(F.lit(255))) == "890100000000000000FF"
    assert value(spark, codec.kilobytes(F.lit(2047))) == 1
