"""A bitmap over hashed keys that tells most rows without a match before they are shuffled.

The bitmap has 16 bits a key, and never more than 2 ** MOST_BITS (32 MB), so its broadcast has a
bound at every size. Rows that it lets through still meet the exact join, so results never depend
on it: with up to 17 million keys about one row in 16 goes to the join for nothing, and with many
more keys the share grows until the sieve lets all rows through and the plain join is left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 28
_PAGE = 15


class Sieve:
    """Built from keys, a table with one bigint column of well mixed hashes; nulls are left out."""

    def __init__(self, keys: DataFrame, most_bits: int = MOST_BITS):
        hashes = keys.toDF("key").dropna()
        self.bits = min(most_bits, max(_PAGE, math.ceil(math.log2(16 * max(1, hashes.count())))))
        page, bit = self._place(F.col("key"))
        self.pages = hashes.groupBy(page.alias("sieve_page")).agg(F.bitmap_construct_agg(bit).alias("sieve_bits"))

    def _place(self, key: Column) -> tuple[Column, Column]:
        place = F.shiftrightunsigned(key, 64 - self.bits)
        return F.shiftright(place, _PAGE), place.bitwiseAND(F.lit((1 << _PAGE) - 1))

    def split(self, rows: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        """(rows that have no match for sure, rows that may have one), columns as given."""
        page, bit = self._place(key)
        names = [f"c{i}" for i in range(len(rows.columns))]
        marked = rows.select("*", page.alias("sieve_own"), bit.alias("sieve_bit")).toDF(*names, "sieve_own", "sieve_bit")
        met = marked.join(F.broadcast(self.pages), F.col("sieve_own") == F.col("sieve_page"), "left")
        byte = F.conv(F.hex(F.substring("sieve_bits", F.shiftright("sieve_bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
        may = F.coalesce(F.getbit(byte, F.col("sieve_bit").bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
        return tuple(met.filter(test).select(*names).toDF(*rows.columns) for test in (~may, may))
