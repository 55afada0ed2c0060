"""Schemas and fixed code tables."""

from __future__ import annotations

from pyspark.sql import types as T

PROFILE = "device_id long, iccid binary, iccid_hex string, state int, nickname string, provider string, profile_name string, is_test_profile boolean, slot_id long"
EVENT = "device_id long, event_id long, ts timestamp, type long, iccid binary, status int, progress_pct int, detail string"
SUBSCRIPTION = "sub_id long, mask long"
SAMPLE = "name string, iter long, us double"
BENCH_RESULT = "name string, mean_us double, median_us double, p99_us double, min_us double, max_us double, iterations int"

# Status codes with their names and messages.
STATUS = [
    (0, "OK", "OK"),
    (1, "PENDING", "Pending"),
    (-1, "INVALID_PARAM", "Invalid parameter"),
    (-2, "NOT_INITIALIZED", "Not initialized"),
    (-3, "HAL_FAILURE", "HAL failure"),
    (-4, "TRANSPORT", "Transport error"),
    (-5, "TLS_HANDSHAKE", "TLS handshake failed"),
    (-6, "EIM_REJECTED", "eIM rejected request"),
    (-7, "PROFILE_NOT_FOUND", "Profile not found"),
    (-8, "PROFILE_ACTIVE", "Profile is active"),
    (-9, "NO_MEMORY", "Out of memory"),
    (-10, "CRYPTO", "Cryptographic error"),
    (-11, "TIMEOUT", "Timeout"),
    (-12, "BUSY", "Resource busy"),
    (-13, "NOT_SUPPORTED", "Not supported"),
    (-14, "TELSDK", "TelSDK backend error"),
    (-99, "INTERNAL", "Internal error"),
]
UNKNOWN_STATUS = "Unknown error"

# Event bits with the text shown for them.
EVENT_BITS = [
    (1, "INSTALLED", "Profile installed"),
    (2, "ENABLED", "Profile ENABLED"),
    (4, "DISABLED", "Profile DISABLED"),
    (8, "DELETED", "Profile DELETED"),
    (16, "EIM_CONNECTED", "eIM connected"),
    (32, "EIM_DISCONNECTED", "eIM disconnected"),
    (64, "NETWORK_ATTACHED", "Network attached"),
    (128, "NETWORK_DETACHED", "Event 128"),
    (256, "PROGRESS", "Download"),
    (512, "ERROR", "Error"),
]
ALL_EVENTS = 0xFFFFFFFF

# Log levels, profile states, line speeds.
LOG_LEVELS = [(0, "NONE"), (1, "ERROR"), (2, "WARN"), (3, "INFO"), (4, "DEBUG")]
STATES = [(0, "ENABLED", "ACTIVE"), (1, "DISABLED", "inactive"), (2, "PENDING_INSTALL", "pending"), (3, "PENDING_ENABLE", "pending"), (4, "ERROR", "pending")]
BAUD_RATES = [9600, 19200, 38400, 57600, 115200, 230400, 460800, 921600]
DEFAULT_BAUD = 115200

# Defaults of the configuration.
DEFAULT_TIMEOUT_MS = 30_000
DEFAULT_RETRIES = 3
CAPACITY = 8

_S, _B, _I, _L = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k.rstrip("_"), v) for k, v in fields.items()])


#: Conformance vectors; every field may be missing.
VECTOR = _struct(
    id=_S,
    group=_S,
    description=_S,
    precondition=_struct(
        telsdk_ready=_B, mock_eid=_S, card_fail_eid=_B, fail_add_profile=_B, download_delay_ms=_I, profiles_downloaded=_I,
        profiles=T.ArrayType(_struct(iccid=_S, active=_B)),
    ),
    input=_struct(
        cfg=_struct(timeout_ms=_I, slot_id=_I, log_level=_S), capacity=_I, count_inout=_S, activation_code=_S, confirmation_code=_S, auto_enable=_B,
        timeout_ms=_I, mode=_S, iccid=_S, nickname=_S, subscribe_mask=_S, action=_S, subscribe_then_unsubscribe=_B, sub_id=_L, buf_len=_I, codes=T.ArrayType(_S),
    ),
    expected=_struct(
        return_=_S, handle=_S, eid_str=_S, eid_len=_I, count=_I, iccid_non_null=_B, profile_count_delta=_I, active_profile_iccid=_S,
        state=_S, state_AA01=_S, state_AA02=_S, profile_exists_after=_B, nickname_after=_S, event_received=_S, callback_not_called=_B,
        callback_status=_S, json_has_eid=_B, json_has_profile_count=_B, json_profile_count_gte=_I, all_non_null=_B, all_non_empty=_B,
    ),
)
