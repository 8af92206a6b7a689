"""Bloom filters on DataFrame functions alone: tell rows that may have a key from rows that surely have not."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter per key; bounds of the size of a part, and parts at most (64 MB in all, whatever the input).
BITS_PER_KEY, LEAST_BITS, MOST_BITS, MOST_PARTS = 16, 1 << 16, 1 << 27, 4


def bits_for(keys: int) -> tuple[int, int]:
    """(bits of a part, parts) for so many keys. Beyond the bounds the filter lets more rows through and loses none."""
    wanted = BITS_PER_KEY * max(1, keys)
    parts = min(MOST_PARTS, math.ceil(wanted / MOST_BITS))
    return min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(wanted / parts)))), parts


class Bloom:
    """The slots that at least ``least`` rows of ``keys`` hit, dealt to parts by bits of their hash.

    ``least`` 1 holds every key, 2 the keys that two rows may share. Slots are counted by partial sums in each task before they shuffle.
    Each part travels to the tasks as one array of 64-bit words.
    """

    def __init__(self, keys: DataFrame, key: str, least: int, rows: int):
        self.bits, self.parts = bits_for(rows)
        self.words = [self._words(keys, key, least, p) for p in range(self.parts)]

    def _hash(self, key: Column) -> tuple[Column, list[Column]]:
        h = F.xxhash64(key)
        return F.pmod(F.shiftright(h, 60), F.lit(self.parts)), [F.pmod(h, F.lit(self.bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(self.bits))]

    def _words(self, keys: DataFrame, key: str, least: int, part: int) -> Column:
        of, slots = self._hash(F.col(key))
        own = keys.filter(of == part) if self.parts > 1 else keys
        hit = own.select(F.explode(F.array(*slots)).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
        words = hit.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))).alias("bits"))
        dense = keys.sparkSession.range(0, self.bits >> 6, 1, 1).join(words, F.col("id") == F.col("word"), "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
        return dense.agg(F.array_sort(F.collect_list(F.struct("id", "bits")))["bits"].alias("filter")).scalar()

    def may_hold(self, key: Column) -> Column:
        of, slots = self._hash(key)

        def on(words: Column) -> Column:
            bit = lambda slot: F.call_function("shiftright", F.get(words, F.shiftright(slot, 6).cast("int")), (slot % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
            return bit(slots[0]) & bit(slots[1])

        found = on(self.words[0])
        for p, words in enumerate(self.words[1:], 1):
            found = F.when(of == p, on(words)).otherwise(found)
        return F.coalesce(found, F.lit(False))
