"""SQL expressions over the words of a text, for operations that stay in the JVM."""

from __future__ import annotations

#: Words are runs of anything but ASCII white space.
SPACE = r"[\\x20\\x09-\\x0D]+"


def words(text: str = "text") -> str:
    """Array of the words; empty for null or blank texts."""
    return f"array_remove(split(coalesce({text}, ''), '{SPACE}'), '')"


def hashes(words_column: str) -> str:
    return f"transform({words_column}, w -> xxhash64(w))"


def windows(hash_column: str, n: int) -> str:
    """Hash of each run of ``n`` neighbours in an array of hashes; empty if there are fewer."""
    neighbours = ", ".join(f"get({hash_column}, i + {k})" for k in range(n))
    return f"transform(if(size({hash_column}) < {n}, array(), sequence(0, size({hash_column}) - {n})), i -> xxhash64({neighbours}))"
