"""Keys of registries that hold hashes instead of texts: XXH64 with seed 0 of the normalised text.

Spark's own ``xxhash64`` has another seed, so that texts are hashed over Arrow batches. A key is the hash as 16
hexadecimal digits, a string like the keys of other registries, so that filters, joins and buckets stay the same.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelight.functions.slices import each


def hash_key(text: str) -> str:
    return xxhash.xxh64_hexdigest(text.encode())


def signed_hash(text: str) -> int:
    """The hash as a database holds it, in 64 bits with a sign."""
    value = xxhash.xxh64_intdigest(text.encode())
    return value - (1 << 64) if value >> 63 else value


@F.arrow_udf(T.StringType())
def hash_key_of(texts: pa.Array) -> pa.Array:
    return each(lambda t: None if t is None else hash_key(t), pa.string(), texts)


@F.arrow_udf(T.LongType())
def signed_hash_of(texts: pa.Array) -> pa.Array:
    return each(lambda t: None if t is None else signed_hash(t), pa.int64(), texts)


def key_of_hash(value: Column) -> Column:
    """The key of a hash that is a long."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def hash_keys(registry: DataFrame, key: str) -> DataFrame:
    """A registry with its text ``key`` hashed, to stand beside others that hold hashes only."""
    return registry.withColumn(key, hash_key_of(F.col(key)))


def author_in(text: bytes, length: int | None, top: int | None) -> bool:
    """Whether ``length`` bytes of ``text`` (4 at least), ending before its end, have a hash with these upper 32 bits."""
    if length is None or top is None or length < 4:
        return False
    return any(xxhash.xxh64_intdigest(text[i : i + length]) >> 32 == top for i in range(len(text) - length))


def _has_author(text: str | None, len1: int | None, hash1: int | None, len2: int | None, hash2: int | None) -> bool:
    body = (text or "").encode()
    return author_in(body, len1, hash1) or author_in(body, len2, hash2)


@F.arrow_udf(T.BooleanType())
def has_hashed_author(texts: pa.Array, len1: pa.Array, hash1: pa.Array, len2: pa.Array, hash2: pa.Array) -> pa.Array:
    return each(_has_author, pa.bool_(), texts, len1, hash1, len2, hash2)
