"""Filters of bounded size that keep rows out of an exchange when a join would drop them anyway.

A filter is a table of bits (``word``, ``bits``: 64 places a row) in which each key sets a few places told by
its XXH64; it never misses a key, and lets others through at a rate that follows from its size. It is
an aggregate (``bit_or`` by word), so that keys are added up where they are. Its size is set by the
number of keys and never exceeds a limit; with more keys than fit, more rows pass, and no result changes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seed of Spark's ``xxhash64``.
SEED = 42
#: Bytes of a filter that is shipped to Python workers, and places of one that is joined (a row for each 64).
MOST_BYTES, MOST_JOINED = 64 << 20, 1 << 26


def size_for(keys: int, most_places: int, places_a_key: int = 10) -> tuple[int, int]:
    """Places (a power of two, 2**32 at most) and places set by each key. With ten places a key, about
    one other key in a hundred passes."""
    places = 1 << min(max(10, (max(1, keys) * places_a_key - 1).bit_length()), most_places.bit_length() - 1, 32)
    return places, max(1, min(8, round(0.69 * places / max(1, keys))))


def _places(key: Column, places: int, hashes: int) -> list[Column]:
    h = F.xxhash64(key)
    low, step = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32).bitwiseOR(1)
    return [(low + i * step).bitwiseAND(places - 1) for i in range(hashes)]


def _bit(place: Column) -> Column:
    return place.bitwiseAND(63).cast("int")


def key_bits(keys: DataFrame, key: str, places: int, hashes: int) -> DataFrame:
    """``word, bits`` of all keys: one row at most for each 64 places."""
    set_ = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), places, hashes))).alias("place"))
    marks = set_.select(F.shiftright("place", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("place"))).alias("mark"))
    return marks.groupBy("word").agg(F.bit_or("mark").alias("bits"))


@dataclass
class KeyFilter:
    """A filter in one piece, for functions over strings in Python."""

    body: bytes
    places: int
    hashes: int

    def may_have(self, text: str) -> bool:
        h = xxhash.xxh64_intdigest(text.encode(), SEED)
        low, step, mask, body = h & 0xFFFFFFFF, (h >> 32) | 1, self.places - 1, self.body
        for i in range(self.hashes):
            place = (low + i * step) & mask
            if not body[place >> 3] >> (place & 7) & 1:
                return False
        return True


def key_filter(keys: DataFrame, key: str, most_bytes: int = MOST_BYTES) -> KeyFilter:
    """The filter of a column of strings. What reaches the driver is bounded by ``most_bytes``."""
    places, hashes = size_for(keys.count(), 8 * most_bytes)
    told = key_bits(keys, key, places, hashes).toArrow()
    words = np.zeros(places // 64, "<i8")
    words[told.column("word").to_numpy()] = told.column("bits").to_numpy()
    return KeyFilter(words.tobytes(), places, hashes)


def likely_in(rows: DataFrame, key: str, keys: DataFrame, of: str, most_places: int = MOST_JOINED) -> DataFrame:
    """Rows whose ``key`` is among ``keys[of]``, and a few others, without an exchange of ``rows``: the filter is
    broadcast, a million rows of two integers at most, and looked up by word. ``keys`` should be cheap to read twice."""
    places, hashes = size_for(keys.count(), most_places, 32)
    hashes = min(2, hashes)  # each is a join
    bits = F.broadcast(key_bits(keys, of, places, hashes))
    columns, rows = rows.columns, rows.where(F.col(key).isNotNull())
    for i in range(hashes):
        mine = bits.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
        rows = rows.withColumn("_place", _places(F.col(key), places, hashes)[i])
        rows = rows.join(mine, F.shiftright("_place", 6) == F.col("_word")).where(F.getbit("_bits", _bit(F.col("_place"))) == 1).select(*columns)
    return rows
