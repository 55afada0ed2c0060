"""Conformance vectors evaluated as one query.

A vector's outcome follows from its precondition and input by the rules of the
lifecycle; every expected field is compared, not only the status.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import hex_digits, missing_activation_code
from ..schema import STATUS


def _explicit_null(field: str) -> Column:
    """Whether an input field is written as null (parsing alone can't tell it from a missing one)."""
    return F.get_json_object("raw", "$.input").rlike(f'"{field}"\\s*:\\s*null')


def _status_code(name: Column) -> Column:
    """Code of a status name, which may have the prefix that a C API gives it."""
    plain = F.regexp_extract(name, "(" + "|".join(n for _, n, _ in STATUS) + ")$", 1)
    return F.create_map(*(F.lit(x) for c, n, _ in STATUS for x in (n, c)))[plain]


def _known() -> Column:
    key = hex_digits(F.col("input.iccid"), 10)
    return F.exists(F.coalesce("precondition.profiles", F.array()), lambda p: hex_digits(p["iccid"], 10) == key)


def actual_status(vectors: DataFrame) -> DataFrame:
    """Vectors with ``actual``, the status that their operation ends with."""
    group, pre = F.col("group"), lambda name: F.col(f"precondition.{name}")
    slow = F.coalesce(pre("download_delay_ms"), F.lit(0)) > F.coalesce(F.nullif(F.col("input.timeout_ms"), F.lit(0)), F.lit(30_000))
    actual = (
        F.when(group.startswith("Initiali"), F.when(_explicit_null("cfg"), -1).when(pre("telsdk_ready") == F.lit(False), -11).otherwise(0))
        .when(group == "EID", F.when(F.coalesce(pre("card_fail_eid"), F.lit(False)), -14).otherwise(0))
        .when(group == "Profile List", F.when(_explicit_null("count_inout"), -1).otherwise(0))
        .when(
            group == "Download",
            F.when(missing_activation_code(F.col("input.activation_code")), -1).when(F.coalesce(pre("fail_add_profile"), F.lit(False)), -14).when(slow, -11).otherwise(0),
        )
        .when(group.isin("Enable", "Disable", "Delete"), F.when(_known(), 0).otherwise(-14))
        .when(group == "Nickname", F.when(_explicit_null("nickname"), -1).when(_known(), 0).otherwise(-14))
        .when(group == "Events", F.when(F.col("input.sub_id").isNotNull(), -1).otherwise(0))
        .when(group == "Diagnostics", F.when(F.col("input.buf_len") < 2, -1).otherwise(0))
        .otherwise(0)
    )
    return vectors.withColumn("actual", actual)


def conformance(vectors: DataFrame) -> DataFrame:
    """``id, group, expected, actual, checks, passed``: every expected field compared null-safely."""
    e, pre = lambda name: F.col(f"expected.{name}"), lambda name: F.col(f"precondition.{name}")
    profiles = F.coalesce(pre("profiles"), F.array())
    listed = F.least(F.size(profiles), F.coalesce("input.capacity", F.lit(16)))
    enabled = F.when(F.col("group") == "Enable", "PROFILE_ENABLED").when(F.col("group") == "Disable", "PROFILE_DISABLED")
    other = F.when(F.col("group") == "Enable", "PROFILE_DISABLED")
    present = (F.col("group") == "Download") & (F.col("actual") == 0)
    wanted_event = F.when(F.col("input.action").startswith("download"), "PROFILE_INSTALLED")

    def check(field: str, value: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), (e(field).isNull() | e(field).eqNullSafe(value)).alias("ok"))

    def named(field: str, value: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), (e(field).isNull() | F.coalesce(e(field).endswith(value), F.lit(False))).alias("ok"))

    status = _status_code(F.coalesce(e("return"), e("callback_status"), F.lit("OK")))
    messages = F.create_map(*(F.lit(x) for c, _, m in STATUS for x in (c, m)))
    codes = F.transform(F.coalesce("input.codes", F.array()), lambda c: messages[_status_code(c)])
    checks = F.array(
        F.struct(F.lit("return").alias("field"), status.eqNullSafe(F.col("actual")).alias("ok")),
        check("eid_str", F.upper(pre("mock_eid"))),
        check("eid_len", F.length(pre("mock_eid"))),
        check("count", listed),
        check("iccid_non_null", present),
        check("profile_count_delta", present.cast("int")),
        check("active_profile_iccid", F.when(present & F.col("input.auto_enable"), "non-null")),
        named("state", enabled),
        named("state_AA01", other),
        named("state_AA02", enabled),
        check("profile_exists_after", ~((F.col("group") == "Delete") & _known())),
        check("nickname_after", F.col("input.nickname")),
        named("event_received", F.when(F.col("input.subscribe_mask").endswith(wanted_event), wanted_event)),
        check("callback_not_called", F.col("input.subscribe_then_unsubscribe")),
        check("json_has_eid", F.lit(True)),
        check("json_has_profile_count", F.lit(True)),
        F.struct(F.lit("json_profile_count_gte").alias("field"), (e("json_profile_count_gte").isNull() | (pre("profiles_downloaded") >= e("json_profile_count_gte"))).alias("ok")),
        check("all_non_null", F.forall(codes, lambda m: m.isNotNull())),
        check("all_non_empty", F.forall(codes, lambda m: m != "")),
    )
    failed = F.transform(F.filter("checks", lambda c: ~c["ok"]), lambda c: c["field"])
    return (
        actual_status(vectors)
        .withColumn("expected_status", status)
        .withColumn("checks", checks)
        .select("id", "group", "expected_status", "actual", F.concat_ws(",", failed).alias("failed"), (F.size(failed) == 0).alias("passed"))
    )


def differences(expected: DataFrame, actual: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``key, failed, passed`` for every row of either side, compared by one shuffled full join.

    ``failed`` names the fields whose values differ (two nulls are equal), in
    their order, or is ``missing`` or ``unexpected`` where a row has no partner.
    Keys are unique on each side; a null in a key equals a null.
    """
    e = expected.select(*(F.col(k).alias(f"__e_{k}") for k in key), F.struct(*fields).alias("__e"))
    a = actual.select(*(F.col(k).alias(f"__a_{k}") for k in key), F.struct(*fields).alias("__a"))
    on = reduce(and_, (F.col(f"__e_{k}").eqNullSafe(F.col(f"__a_{k}")) for k in key))
    differs = [F.when(~F.col(f"__e.{f}").eqNullSafe(F.col(f"__a.{f}")), F.lit(f)) for f in fields]
    failed = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").otherwise(F.concat_ws(",", *differs))
    keys = [F.when(F.col("__e").isNull(), F.col(f"__a_{k}")).otherwise(F.col(f"__e_{k}")).alias(k) for k in key]
    return e.join(a, on, "full").select(*keys, failed.alias("failed"), (failed == "").alias("passed"))
