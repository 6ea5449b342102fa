"""Numbers as text, and as the eight bytes of IBM's floating point."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def shortest_text(x: pd.Series) -> pd.Series:
    """The shorter of 15 and 17 significant digits that reads back as the same number; none for what isn't finite."""

    def one(v: float | None) -> str | None:
        if v is None or not np.isfinite(v):
            return None
        short = f"{v:.15g}"
        return short if float(short) == v else f"{v:.17g}"

    return x.map(one, na_action="ignore").astype(object).where(x.notna(), None)


def code_text(c: Column, kind: str) -> Column:
    """A value as it stands in a codelist: 1.0 is written 1, and other numbers with 15 significant digits."""
    if kind not in ("double", "float"):
        return c.cast("string")
    plain = (c % 1 == 0) & (F.abs(c) < 1e15)
    return F.coalesce(F.when(plain, c.cast("long").cast("string")), shortest_text(F.when(~plain, c.cast("double"))))


def whole(c: Column) -> Column:
    """Whether a number is finite and whole."""
    return finite(c) & (c % 1 == 0)


def finite(c: Column) -> Column:
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))


#: The greatest magnitude that fits, the least that doesn't vanish, and indicators of missing values.
IBM_MAX, IBM_MIN = 16.0**63, 16.0**-65
_MISSING = {0x2E: ".", 0x5F: "._"} | {65 + i: f".{chr(65 + i)}" for i in range(26)}
_TAG_BYTE = {t: b for b, t in _MISSING.items()}


def to_ibm(values: np.ndarray, tags: list[str | None] | None = None) -> np.ndarray:
    """(n, 8) bytes of doubles: sign, exponent of 16 in excess 64, 56 bits of fraction. NaN is missing, by its tag."""
    v = np.asarray(values, float)
    miss = np.isnan(v)
    mantissa, exponent = np.frexp(np.where(miss, 0.0, np.abs(v)))
    hexes = -(-exponent // 4)  # the power of 16 that leaves a fraction of 1/16 to 1
    fraction = np.ldexp(mantissa, exponent - 4 * hexes + 56).astype(np.uint64)
    small = (fraction == 0) | (hexes < -64)
    if np.any((hexes > 63) & ~miss):
        raise OverflowError("a value is too large for the format")
    word = (fraction & np.uint64(2**56 - 1)) | ((hexes + 64).astype(np.uint64) & np.uint64(127)) << np.uint64(56)
    word = np.where(small, np.uint64(0), word | (np.signbit(v).astype(np.uint64) << np.uint64(63)))
    out = word.astype(">u8").view(np.uint8).reshape(-1, 8).copy()
    if miss.any():
        out[miss] = 0
        names = tags if tags is not None else [None] * len(v)
        out[miss, 0] = [_TAG_BYTE.get(names[i] or ".", 0x2E) for i in np.flatnonzero(miss)]
    return out


def from_ibm(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles of (n, 8) bytes, and the tags of missing ones; a plain missing value has the tag None."""
    raw = np.ascontiguousarray(raw, np.uint8)
    first, rest = raw[:, 0], raw[:, 1:]
    miss = (rest == 0).all(axis=1) & np.isin(first, list(_MISSING))
    word = raw.view(">u8").reshape(-1).astype(np.uint64)
    fraction = (word & np.uint64(2**56 - 1)).astype(float)
    power = ((word >> np.uint64(56)) & np.uint64(127)).astype(int) - 64
    v = np.ldexp(fraction, 4 * power - 56)
    v = np.where(first & 0x80, -v, v)
    tags = np.full(len(raw), None, object)
    for i in np.flatnonzero(miss):
        tags[i] = _MISSING[int(first[i])] if first[i] != 0x2E else None
    return np.where(miss, np.nan, v), tags
