"""Event identifiers: 48 bits of milliseconds and 80 random bits in 26 base-32 characters."""

from __future__ import annotations

import secrets
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: Crockford's base-32 alphabet.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
TIME_CHARS, RANDOM_CHARS = 10, 16


def new_ulid(millis: int | None = None) -> str:
    value = (int(time.time() * 1000) if millis is None else millis) << 80 | secrets.randbits(80)
    return "".join(ALPHABET[value >> shift & 31] for shift in range(125, -1, -5))


def time_of(ulid: str) -> int:
    """Milliseconds of an identifier."""
    value = 0
    for c in ulid[:TIME_CHARS]:
        value = value << 5 | ALPHABET.index(c)
    return value


def _symbol(bits: Column) -> Column:
    return F.substr(F.lit(ALPHABET), bits.cast("int") + 1, F.lit(1))


def time_prefix(timestamp: Column) -> Column:
    """The ten characters that carry the time."""
    millis = F.unix_millis(timestamp.cast("timestamp"))
    return F.concat(*(_symbol(F.shiftright(millis, s).bitwiseAND(F.lit(31))) for s in range(45, -1, -5)))


def random_suffix(seed: Column | None = None) -> Column:
    """Sixteen characters: from a fresh uuid, or always the same ones for equal values of ``seed``."""
    text = F.md5((F.uuid() if seed is None else seed).cast("string"))
    nibbles = [F.conv(F.substring(text, 2 * i + 1, 2), 16, 10).cast("int") for i in range(RANDOM_CHARS)]
    return F.concat(*(_symbol(n.bitwiseAND(F.lit(31))) for n in nibbles))


def ulid_column(timestamp: Column, seed: Column | None = None) -> Column:
    return F.concat(time_prefix(timestamp), random_suffix(seed))
