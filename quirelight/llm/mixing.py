"""Operator 3 [native]: mixing sources to target weights by a splitting tree of block quotas.

Words are counted per document, documents are dealt by hash into blocks of their source, and
each source gets a target. A source's draws are whole passes over its blocks and then as many
blocks of its permuted order as fill the rest; the block at the end is cut inside, so that the
words taken equal the rounded target. The vector of draws per source is then split between the
output shards along a binary tree: each node hands half of its draws to its left child, with
the counts per source drawn from the multivariate hypergeometric distribution (one conditional
hypergeometric draw per source, by inversion with a hashed uniform number). A leaf owns a
contiguous range of each source's permuted draws, so that no two shards draw the same one;
within a shard rows are ordered by a hash. A corpus of more shards than the tree has leaves cuts each
leaf by the hash of its draws. Only DataFrame functions take part.

Sources meet in windows without a partition and in the tree's nodes, a few bytes each: made for sources
that are collections (up to some 100,000), not for each host of a crawl.

Defined results: a null or empty text has size 0 and is never drawn; a null source is a source
of its own, ordered last; rows that repeat are separate documents, each with draws of its own; an empty table
gives an empty result. Equal input and seed give equal results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelight.llm.common import WORD_PATTERN, checkpoint

#: Documents a block holds at most on average, and blocks a source has at least.
BLOCK_ROWS = 4096
LEAST_BLOCKS = 64
#: Words a shard holds, shards at least, and leaves of the splitting tree at most.
SHARD_WORDS, LEAST_SHARDS, MOST_LEAVES = 1 << 24, 64, 8192
#: A word and the white space before it.
SPACED_WORD_PATTERN = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"


def _uniform(*parts) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated, and stands in the plan, only once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 8."""

    def of(x: Column) -> Column:
        small = x + 1.0
        for i in range(2, 9):
            small = small * (x + float(i))
        return _let(x + 9.0, lambda y: (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y)) - F.log(small)

    return _let(x, of)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def hypergeometric(total: Column, marked: Column, draws: Column, uniform: Column) -> Column:
    """A draw of how many of ``marked`` among ``total`` fall in ``draws``, by inversion over the
    support within ten standard deviations, beyond which a uniform double cannot point."""
    given = F.struct(total.cast("double").alias("n"), marked.cast("double").alias("k"), draws.cast("double").alias("d"), uniform.alias("u"))
    return _let(given, _draw)


def _draw(g: Column) -> Column:
    n, k, d = g["n"], g["k"], g["d"]
    mean = F.when(n > 0, d * k / n).otherwise(0.0)

    def bounds(mean: Column) -> Column:
        sd = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), mean * (1 - k / n) * (n - d) / (n - 1)))).otherwise(0.0)
        return _let(sd, lambda sd: F.struct(F.greatest(F.lit(0.0), d + k - n, F.floor(mean - 10 * sd - 1)).alias("low"), F.least(k, d, F.ceil(mean + 10 * sd + 1)).alias("high")))

    def walk(b: Column) -> Column:
        low, high = b["low"], b["high"]
        first = F.exp(_log_choose(k, low) + _log_choose(n - k, d - low) - _log_choose(n, d))
        return F.aggregate(
            F.sequence(low.cast("long"), F.greatest(low, high).cast("long")),
            F.struct(first.alias("p"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("pick")),
            lambda s, i: F.struct(
                F.when(i < high, s["p"] * (k - i) * (d - i) / ((i + 1) * (n - k - d + i + 1))).otherwise(0.0).alias("p"),
                (s["sum"] + s["p"]).alias("sum"),
                F.when((s["pick"] < 0) & (s["sum"] + s["p"] >= g["u"]), i).otherwise(s["pick"]).alias("pick"),
            ),
            lambda s: F.when(s["pick"] >= 0, s["pick"]).otherwise(high.cast("long")),
        )

    return _let(_let(mean, bounds), walk)


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Adds ``ord`` and ``target`` to (source, source_size): shares by weight of ``share`` times
    all sizes, none above ``most`` times its source's size. One row per source takes part."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("ord") % len(weights) + 1).cast("int")).cast("double")
    ranked = sources.withColumn("ord", F.row_number().over(everything) - 1).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    filled = (
        ranked.withColumn("rest", share * F.sum("source_size").over(whole) - (F.sum("cap").over(by_ratio) - F.col("cap")))
        .withColumn("rest_weight", F.sum("weight").over(whole) - (F.sum("weight").over(by_ratio) - F.col("weight")))
        .withColumn("level", F.col("rest") / F.col("rest_weight"))
        .withColumn("capped", F.col("level") >= F.col("cap") / F.col("weight"))
        # The first source below its cap, in order of the ratio, sets the level of all that follow.
        .withColumn("common", F.max(F.when(~F.col("capped"), F.col("level"))).over(whole))
    )
    return filled.select("source", "source_size", "ord", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("common") * F.col("weight")).alias("target"))


def _tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(ord, quota) to (ord, starts): where each shard's range of the source's draws starts."""
    item = "array<struct<ord:int,start:long,quota:long>>"
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("ord", F.lit(0).cast("long").alias("start"), "quota"))).cast(item).alias("items")).select(F.lit(1).cast("long").alias("node"), "items")
    while shards > 1:
        items = F.col("items")
        total = F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x["quota"])

        def give(s, x):
            left = hypergeometric(s["pool"], x["quota"], s["draws"], _uniform(F.lit(seed), F.col("node"), x["ord"]))
            return _let(left, lambda n: F.struct((s["pool"] - x["quota"]).alias("pool"), (s["draws"] - n).alias("draws"), F.concat(s["left"], F.array(n)).alias("left")))

        start = F.struct(total.alias("pool"), F.floor(total / 2).cast("long").alias("draws"), F.array().cast("array<long>").alias("left"))
        split = nodes.select("node", "items", F.aggregate(items, start, give, lambda s: s["left"]).alias("left"))
        part = lambda f: F.zip_with(F.col("items"), F.col("left"), f)
        left = part(lambda x, n: F.struct(x["ord"].alias("ord"), x["start"].alias("start"), n.alias("quota")))
        right = part(lambda x, n: F.struct(x["ord"].alias("ord"), (x["start"] + n).alias("start"), (x["quota"] - n).alias("quota")))
        nodes = split.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), left.cast(item).alias("items")), F.struct((F.col("node") * 2 + 1).alias("node"), right.cast(item).alias("items")))).alias("c")).select("c.*")
        shards //= 2
    return nodes.select("node", F.explode("items").alias("x")).groupBy("x.ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "x.start"))), lambda x: x["start"]).alias("starts"))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _sized(docs: DataFrame, source: str, text: str, key: str) -> DataFrame:
    return checkpoint(docs.select(docs[key].cast("long").alias("id_of_mix"), docs[source].cast("string").alias("source_of_mix"), _size(docs[text]).alias("size_of_mix"), _spread(docs[key], docs[text]).alias("spread_of_mix")))


def _spread(key: Column, text: Column) -> Column:
    """What blocks are dealt by: ids may be null or repeat, in a third of all rows, say."""
    return F.xxhash64(key.cast("long"), text)


def _drawn(sized: DataFrame, rows: DataFrame, weights: tuple[int, ...], share: float, most: int, shards: int | None, seed: int, ties: tuple[Column, ...] = ()) -> DataFrame:
    """``rows`` (id_of_mix, source_of_mix, size_of_mix, spread_of_mix, as in ``sized``, and any others) with
    source_size_of_mix, target_of_mix and draws_of_mix: (copy, shard, words) of each time the mix
    takes the row. Rows join blocks of their source, never each other. ``ties`` order rows of one id and size."""
    sized = sized.toDF("id", "source", "size", "spread")
    n_rows, words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks_each = max(LEAST_BLOCKS, -(-n_rows // BLOCK_ROWS))
    wanted = shards or max(LEAST_SHARDS, 1 << int(share * words / SHARD_WORDS).bit_length())
    leaves, parts = min(wanted, MOST_LEAVES), max(1, wanted // MOST_LEAVES)
    block_of = lambda spread: F.pmod(F.xxhash64(F.lit(seed), spread), F.lit(blocks_each)).cast("int")
    blocks = checkpoint(sized.groupBy("source", block_of(F.col("spread")).alias("block")).agg(F.sum("size").alias("words")))
    aimed = (
        targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", (F.round("target") - F.col("passes") * F.col("source_size")).cast("long"))
    )
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "block"), "block")
    ranked = (
        blocks.withColumn("place", F.row_number().over(order).cast("long") - 1)
        .withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words"))
        .withColumn("n_blocks", F.count("*").over(Window.partitionBy("source")))
        .withColumnRenamed("source", "block_source")
        .join(aimed, F.col("block_source").eqNullSafe(aimed["source"]))
        .drop("block_source")
        .withColumn("own_rest", F.least(F.col("words"), F.greatest(F.lit(0), F.col("rest") - F.col("before"))).cast("long"))
    )
    ranked = checkpoint(ranked)
    quotas = ranked.groupBy("ord").agg((F.max("passes") * F.max("n_blocks") + F.sum((F.col("own_rest") > 0).cast("long"))).cast("long").alias("quota"))
    starts = _tree(quotas, leaves, seed + 2)
    shard_of = lambda place: (F.size(F.filter("starts", lambda x: x <= place)) - 1).cast("int")
    # Full passes come first in a source's draws, then the blocks that fill the rest.
    whole = F.transform(F.when(F.col("passes") > 0, F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).otherwise(F.array().cast("array<long>")), lambda p: F.struct(p.cast("int").alias("copy"), shard_of(p * F.col("n_blocks") + F.col("place")).alias("shard")))
    last = F.when(F.col("own_rest") > 0, shard_of(F.col("passes") * F.col("n_blocks") + F.col("place")))
    drawn = ranked.join(starts, "ord").select(
        F.col("source").alias("block_source"), F.col("block").alias("own_block"), F.col("words").alias("block_words"), F.col("source_size").alias("source_size_of_mix"),
        F.col("target").alias("target_of_mix"), F.col("passes").alias("passes_of_mix"), "own_rest", whole.alias("whole_of_mix"), last.alias("last_of_mix"),
    )
    drawn = checkpoint(drawn)
    dealt = rows.withColumn("block_of_mix", block_of(F.col("spread_of_mix")))
    joined = dealt.join(drawn, F.col("source_of_mix").eqNullSafe(F.col("block_source")) & (F.col("block_of_mix") == F.col("own_block")), "left")
    # In the block where a source's target ends, its rows are taken in hashed order up to it.
    cut = (F.col("own_rest") > 0) & (F.col("own_rest") < F.col("block_words"))
    within = Window.partitionBy("source_of_mix", "block_of_mix").orderBy(F.xxhash64(F.lit(seed + 3), "id_of_mix"), "id_of_mix", "size_of_mix", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = [*rows.columns, "source_size_of_mix", "target_of_mix", "passes_of_mix", "whole_of_mix", "last_of_mix", "rest_of_mix"]
    size = F.col("size_of_mix")
    inside = joined.where(cut).withColumn("rest_of_mix", F.least(size, F.greatest(F.lit(0), F.col("own_rest") - (F.sum("size_of_mix").over(within) - size)))).select(kept)
    others = joined.where(~F.coalesce(cut, F.lit(False))).withColumn("rest_of_mix", F.when(F.col("own_rest") > 0, size).otherwise(F.lit(0).cast("long"))).select(kept)

    def draw(copy: Column, leaf: Column, words: Column) -> Column:
        # A leaf of the tree that would be too large a shard is cut by a hash of the draw.
        part = F.pmod(F.xxhash64(F.lit(seed + 5), "id_of_mix", copy), F.lit(parts)).cast("int") if parts > 1 else F.lit(0)
        return F.struct(copy.cast("int").alias("copy"), (leaf * F.lit(parts) + part).cast("int").alias("shard"), words.alias("words"))

    draws = F.filter(F.concat(F.transform("whole_of_mix", lambda x: draw(x["copy"], x["shard"], size)), F.array(draw(F.col("passes_of_mix"), F.col("last_of_mix"), F.col("rest_of_mix")))), lambda x: x["words"] > 0)
    return inside.unionAll(others).select(*rows.columns, "source_size_of_mix", "target_of_mix", draws.alias("draws_of_mix"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, shards: int | None = None, seed: int = 7, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, draws, taken``; ``draws``
    lists (copy, shard, words) of each time the mix takes it. ``shards`` is a power of two; without
    it a shard gets about SHARD_WORDS, and there are LEAST_SHARDS at least."""
    sized = _sized(docs, source, text, key)
    found = _drawn(sized, sized, weights, share, most, shards, seed)
    found = found.drop("spread_of_mix").toDF("doc_id", "source", "size", "source_size", "target", "draws")
    return found.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x["words"]))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, shards: int | None = None, seed: int = 7, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """The mixed rows: the columns of ``docs``, once per draw, with ``mix_shard``; a draw of fewer
    words than the text has holds its first words, with the white space between them. Rows of a shard come in
    hashed order. Columns may have any names but ``mix_shard``."""
    # Columns go under names of their own, which no inner name can clash with.
    flat = docs.toDF(*(f"c{i}_of_mix" for i in range(len(docs.columns))))
    text_, key_, source_ = (flat.columns[docs.columns.index(c)] for c in (text, key, source))
    own = flat.withColumns({"id_of_mix": F.col(key_).cast("long"), "source_of_mix": F.col(source_).cast("string"), "size_of_mix": _size(F.col(text_)), "spread_of_mix": _spread(F.col(key_), F.col(text_))})
    found = _drawn(_sized(docs, source, text, key), own, weights, share, most, shards, seed, (F.xxhash64(text_),)).where(F.size("draws_of_mix") > 0)
    rows = found.select(*own.columns, F.explode("draws_of_mix").alias("draw_of_mix"))
    words = F.col("draw_of_mix.words")
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text_), F.lit(SPACED_WORD_PATTERN), F.lit(0)), F.lit(1), words.cast("int")), "")
    rows = rows.withColumn(text_, F.when(words < F.col("size_of_mix"), first).otherwise(F.col(text_)))
    order = F.xxhash64(F.lit(seed + 4), F.col(key_), F.col("draw_of_mix.copy"))
    rows = rows.select(*flat.columns, F.col("draw_of_mix.shard").alias("shard_of_mix"), order.alias("order_of_mix"))
    dealt = rows.repartition("shard_of_mix").sortWithinPartitions("shard_of_mix", "order_of_mix").drop("order_of_mix")
    return dealt.toDF(*docs.columns, "mix_shard")
