"""Scalar functions as Column expressions (no Python code runs on rows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BAUD_RATES, DEFAULT_BAUD, LOG_LEVELS, STATUS, UNKNOWN_STATUS


def _choose(column: Column, pairs, default) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for key, value in pairs:
        out = out.when(column == F.lit(key), F.lit(value))
    return out.otherwise(F.lit(default))


def to_hex(binary: Column) -> Column:
    """Bytes as upper-case hexadecimal."""
    return F.hex(binary)


def hex_digits(text: Column, n_bytes: int) -> Column:
    """The normal form of a hex text of ``n_bytes``: a lone last digit is its own byte, extra digits go, zeros fill up."""
    n = F.length(text)
    whole = F.when(n % 2 == 1, F.concat(F.substring(text, F.lit(1), n - 1), F.lit("0"), F.right(text, F.lit(1)))).otherwise(text)
    return F.upper(F.rpad(F.left(whole, F.lit(2 * n_bytes)), 2 * n_bytes, "0"))


def from_hex(text: Column, n_bytes: int) -> Column:
    """Exactly ``n_bytes`` bytes of a hex text; null if a digit is invalid."""
    return F.unhex(hex_digits(text, n_bytes))


def iccid_hex(device: Column, slot: Column) -> Column:
    """A 20-digit identifier made of a prefix, the device and the slot."""
    return F.concat(F.lit("8901"), F.lpad(F.hex(device.cast("long")), 8, "0"), F.lpad(F.hex(slot.cast("long")), 8, "0"))


def synthesized_iccid(activation_code: Column) -> Column:
    """A 20-digit identifier from an activation code; always the full width."""
    return F.concat(F.lit("8901230000000000"), F.lpad(F.pmod(F.xxhash64(activation_code), F.lit(10_000)).cast("string"), 4, "0"))


def cut_text(text: Column, characters: int = 63) -> Column:
    """Text cut to a number of characters (not bytes, so that no character is split)."""
    return F.left(text, F.lit(characters))


def status_message(code: Column) -> Column:
    return _choose(code, [(c, m) for c, _, m in STATUS], UNKNOWN_STATUS)


def status_code(name: Column) -> Column:
    """Code of a status name, null if there is no such name."""
    return _choose(name, [(n, c) for c, n, _ in STATUS], None).cast("int")


def backend_status(name: Column) -> Column:
    """Library status of a backend's result."""
    return _choose(name, [("SUCCESS", 0), ("FAILED", -14), ("INVALID", -1), ("NOT_SUPPORTED", -13)], -14)


def level_tag(level: Column) -> Column:
    """Name of a log level, padded to five characters."""
    return F.rpad(_choose(level, [p for p in LOG_LEVELS if p[0]], "?"), 5, " ")


def user_level(name: Column) -> Column:
    """Internal level of a user's choice of detail."""
    return _choose(name, [("SIMPLE", 3), ("DETAIL", 4)], 0)


def log_line(ts: Column, level: Column, module: Column, message: Column, detail: bool) -> Column:
    """``[time] [LEVEL] [module] message``; with milliseconds (cut, not rounded) if ``detail``."""
    stamp = F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS" if detail else "yyyy-MM-dd HH:mm:ss")
    return F.format_string("[%s] [%s] [%s] %s", stamp, level_tag(level), module, message)


def line_speed(baud: Column) -> Column:
    return F.when(baud.isin(BAUD_RATES), baud).otherwise(F.lit(DEFAULT_BAUD))


def or_default(value: Column, default: int) -> Column:
    """``default`` for null and 0."""
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default))


def short_number(value: Column) -> Column:
    """One decimal, or ``< 0.1`` below that."""
    return F.when(value >= 0.1, F.format_string("%.1f", value)).otherwise(F.lit("< 0.1"))


def percent_of(part: Column, whole: Column) -> Column:
    """Percentage, at most 100; 0 of nothing is 0."""
    share = part.cast("double") * 100 / F.nullif(whole, F.lit(0))
    return F.when(share.isNull(), 0.0).otherwise(F.least(share, F.lit(100.0)))


def text_bar(percent: Column, cells: int = 20) -> Column:
    """A bar of ``#`` and ``.``."""
    filled = F.floor(percent * cells / 100).cast("int")
    return F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("."), F.lit(cells) - filled))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "_")


def colour(value: Column) -> Column:
    """``#RRGGBB`` of a number."""
    return F.concat(F.lit("#"), F.lpad(F.hex(value.cast("long")), 6, "0"))


def self_test(ready: Column, card: Column) -> Column:
    """Bit 0: subsystem ready; bit 1: card found."""
    return ready.cast("int").bitwiseOR(F.shiftleft(card.cast("int"), 1))


def elapsed_us(start: Column, end: Column) -> Column:
    """Microseconds between two timestamps with or without zone."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return micros(end) - micros(start)


def missing_activation_code(code: Column) -> Column:
    """Codes that are null or empty can't be used."""
    return F.coalesce(code, F.lit("")) == ""


def or_unknown(text: Column, default: str = "N/A") -> Column:
    """``default`` for null, as where a tool gives no output."""
    return F.coalesce(text, F.lit(default))


def clamped(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def moved_cursor(at: Column, by: int, size: Column) -> Column:
    """A list cursor moved by ``by``, around the ends of a list of ``size``; 0 in an empty list."""
    return F.when(size > 0, F.pmod(at + by, size)).otherwise(F.lit(0))


def thousands(value: Column) -> Column:
    """A whole number with commas between groups of three digits."""
    return F.format_number(value.cast("long"), 0)


def kilobytes(size: Column) -> Column:
    """Whole kilobytes (1024), rounded down."""
    return F.floor(size / 1024).cast("long")


def eid_hex(device: Column) -> Column:
    """A 32-digit chip identifier made of a prefix and the device."""
    return F.concat(F.lit("89049032"), F.lpad(F.hex(device.cast("long")), 24, "0"))


def lower_hex(number: Column) -> Column:
    """``0x`` and the lower-case hexadecimal digits of a whole number."""
    return F.concat(F.lit("0x"), F.lower(F.hex(number.cast("long"))))


def counted_iccid(number: Column) -> Column:
    """A 20-digit identifier from a running number."""
    return F.concat(F.lit("8901"), F.lpad(F.hex(number.cast("long")), 16, "0"))


def required_status_code(name: Column) -> Column:
    """Code of a status name; a name that there isn't ends the query with an error that says which.

    A null name has a null code.
    """
    code = status_code(name)
    return F.when(name.isNotNull() & code.isNull(), F.raise_error(F.concat(F.lit("unknown status name: "), name)).cast("int")).otherwise(code)


# For each call whether its handle has to be there and ready, and the argument that has to be given.
CALLS = [
    ("init", None, "config"), ("deinit", "there", None), ("configure", "there", "config"), ("version", None, "out"), ("list", "ready", "count"),
    ("download", "ready", "activation_code"), ("nickname", "ready", "nickname"), ("unsubscribe", "there", None), ("pump", "there", None), ("diagnostics", "there", "buffer"),
]
LEAST_BUFFER = 2


def argument_status(call: Column, handle: Column, ready: Column, argument: Column, length: Column) -> Column:
    """-1 where a call can't be made with its arguments, else 0.

    ``handle``, ``ready`` and ``argument`` tell whether there is a handle, whether it was
    initialised, and whether the call's argument is given; ``length`` is that of
    the buffer of ``diagnostics``.  Calls without a name here are invalid.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = F.lit(False)
    for name, needs, wanted in CALLS:
        ok = F.lit(True)
        if needs:
            ok = yes(handle) & (yes(ready) if needs == "ready" else F.lit(True))
        if wanted:
            ok = ok & yes(argument)
        if wanted == "buffer":
            ok = ok & yes(length >= LEAST_BUFFER)
        out = F.when(call == name, ok).otherwise(out)
    return F.when(out, 0).otherwise(-1)
