"""A set of 64-bit hashes as a bitmap of bounded size, for tasks that drop what no join would keep.

The bitmap has about ``PER`` bits for each hash but at most 2 ** MOST_BITS (64 MB), so it may be
broadcast; what passes it by chance must be dropped by an exact join later. A set of n hashes
lets n / 2 ** MOST_BITS of others pass, a tenth at fifty million.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER, LEAST_BITS, MOST_BITS = 32, 12, 29
_U = np.uint64


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """The bitmap of a long column, by the upper bits of its values."""
    size = min(MOST_BITS, max(LEAST_BITS, (PER * df.count()).bit_length()))
    place = F.shiftrightunsigned(column, 64 - size)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    words = df.select(F.shiftright(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    got = words.toArrow()  # at most 2 ** (MOST_BITS - 6) rows
    out = np.zeros(1 << (size - 6), np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(_U)


def contained(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the set."""
    place = h >> _U(64 - 6 - (len(bits).bit_length() - 1))
    return (bits[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) > 0
