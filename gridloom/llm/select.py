"""Exact selection by rank over distributed keys, without sorting them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the key settled by each pass; a pass brings at most 2 ** BITS sums to the driver.
BITS = 16


def ordered_key(values: np.ndarray) -> np.ndarray:
    """64-bit integers that sort as the doubles do (-0.0 and 0.0 apart)."""
    bits = np.ascontiguousarray(values, dtype=np.float64).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def kth_largest(rows: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest value of a bigint column: at least k rows are not below it, fewer are above.  None if there are fewer than k rows or k is 0.  Null keys don't count; equal keys count as often as they occur.

    Each pass counts rows by the next BITS bits of the key, within what is still open;
    partial counts are made before the shuffle, so no key is hot.
    """
    if k <= 0:
        return None
    left, base, bits = k, -(1 << 63), 64
    while bits:
        bits -= BITS
        top = base + (1 << (bits + BITS)) - 1
        here = rows.where(F.col(key).between(base, top))
        cells = here.groupBy(F.shiftright(F.col(key), bits).alias("cell")).count().collect()
        for r in sorted(cells, key=lambda r: -r["cell"]):
            if r["count"] >= left:
                base = r["cell"] << bits
                if r["count"] == left == 1 and bits:  # the only row: no need to narrow further
                    return rows.where(F.col(key).between(base, base + (1 << bits) - 1)).agg(F.max(key)).collect()[0][0]
                break
            left -= r["count"]
        else:
            return None
    return base
