"""Operator 12: quality rules with risk-controlled thresholds, in DataFrame functions only.

A base rule and four rules of the form "measure above (or below) a cutoff" reject documents. The
cutoffs are not set by hand: each rule has a fixed ladder of cutoffs from lenient to strict, and
each stratum (a value of ``lang``, null being one of its own) takes the strictest one of which
labelled good documents prove that it rejects few. With n good documents of which r are rejected, a cutoff is proven
if P(Binomial(n, risk) <= r) is at most its level, which is the exact (Clopper-Pearson) upper bound
staying under ``risk``. Ladders are walked from their lenient end and stop at the first cutoff that is not
proven, which needs no correction within a ladder; over ladders and strata the level is divided by
their number (Bonferroni), and the tolerated share of good documents by the number of rules. So with
probability 1 - ``error``, in every stratum at once, the rules together reject at most ``risk`` of
the good documents that pass the base rule. A stratum with too few labelled documents keeps the
lenient end, that is, no rule.

Measures are whole-text counts (see ``measures``). Text is read once: its counts go to a checkpoint,
and nothing but counts is shuffled after that.

Defined results: a null or empty text has no words, so that it fails the base rule; rows that
repeat are judged one by one, and count each in the proof; ids whose labels contradict each other,
labels other than 0 and 1, and null ids prove nothing; without labels only the base rule rejects;
empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import WHITE, checkpoint, dealt_again

#: Tolerated share of good documents rejected in a stratum, and the probability that any stratum exceeds it.
RISK, ERROR = 0.05, 0.05
#: Rules: a measure over another in hundredths, whether values above or below the cutoff are rejected, and
#: cutoffs from lenient to strict.
LADDERS = {
    "symbols": ("n_symbols", "n_words", "above", (400, 200, 100, 70, 50, 30, 20, 15, 10, 7, 5, 3, 2, 1)),
    "long_words": ("word_chars", "n_words", "above", (2000, 1500, 1200, 1100, 1000, 950, 900, 850, 800, 750, 700, 650, 600)),
    "short_words": ("word_chars", "n_words", "below", (150, 200, 250, 300, 325, 350, 375, 400, 425, 450)),
    "repeated_lines": ("n_dup_lines", "n_lines", "above", (95, 90, 80, 70, 60, 50, 40, 35, 30, 25, 20)),
}
#: Cutoff tables of up to so many strata are broadcast (a few hundred bytes each); larger ones are joined.
BROADCAST_STRATA = 10_000
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds, for the whole text of each row:

    ``n_words`` (runs of other than ASCII white space), ``word_chars`` (code points in them),
    ``n_symbols`` (characters of ``#*$%&|<>``), ``n_lines`` and ``n_dup_lines`` (lines with a word, and
    those equal to an earlier one), ``n_repeat_words`` (words that stand in a window of three words
    found twice or more in the text).

    Windows are told apart by XXH64 of their words (two different ones of a text of n words are taken for
    equal with probability below n * n / 2**65); equal ones meet by sorting within the row, so that a text
    takes n log n steps.
    """
    body = F.coalesce(docs[text], F.lit(""))
    bare = F.btrim(body, F.lit(WHITE))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.withColumns({
        "_words": F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")),
        "_lines": lines,
        "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
    })
    rows = rows.withColumns({
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_words": F.size("_words").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    # Hashes of the windows; only texts in which one repeats are sorted. Columns are zipped rather than
    # indexed, which keeps all but the hash and one comparison in generated code.
    shifted = lambda c, by: F.slice(c, by + 1, F.greatest(F.size(c) - by, F.lit(0)))
    windows = F.slice(F.arrays_zip("_words", shifted("_words", 1), shifted("_words", 2)), 1, F.greatest(F.size("_words") - 2, F.lit(0)))
    rows = rows.withColumn("_hashes", F.transform(windows, lambda x: F.xxhash64(x))).drop("_words", "_lines")
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    places = F.sort_array(F.arrays_zip(F.col("_hashes").alias("h"), F.sequence(F.lit(1), F.size("_hashes")).alias("i")))
    rows = rows.withColumn("_places", F.when(repeats, places)).drop("_hashes")
    rows = rows.withColumns({"_h": F.col("_places.h"), "_i": F.col("_places.i")}).drop("_places")
    pairs = F.arrays_zip("_h", shifted("_h", 1).alias("next_h"), "_i", shifted("_i", 1).alias("next_i"))
    rows = rows.withColumn("_found", F.filter(pairs, lambda x: x["_h"] == x["next_h"])).drop("_h", "_i")
    rows = rows.withColumn("_at", F.sort_array(F.array_union(F.col("_found._i"), F.col("_found.next_i")))).drop("_found")
    # A window covers three words, or as many as lie before the next window found.
    covered = F.transform("_at", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1) - x, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_at")


def base_failed() -> Column:
    """The base rule over ``measures``."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _first_step(rule: str) -> Column:
    """The first cutoff of the ladder, counted from 1, that rejects the row; one past the end if none does."""
    over, under, side, cutoffs = LADDERS[rule]
    value, scale = 100 * F.col(over), F.col(under)
    broken = [F.when((value > t * scale) if side == "above" else (value < t * scale), 1).otherwise(0) for t in cutoffs]
    return len(cutoffs) + 1 - reduce(lambda a, b: a + b, broken)


def _log_gamma(x: Column) -> Column:
    """Of x >= 1, by Stirling's series eight places up."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    product = reduce(lambda a, b: a * b, [x + i for i in range(8)])
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def binomial_at_most(r: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= r) in double precision: the probability of r times a sum of falling ratios.
    Terms further than 20 sqrt(n) below r (40 standard deviations at least) are left out, which no double shows."""
    r, n = r.cast("double"), n.cast("double")
    at = F.exp(_log_gamma(n + 1) - _log_gamma(r + 1) - _log_gamma(n - r + 1) + r * math.log(p) + (n - r) * math.log1p(-p))
    steps = F.sequence(F.lit(0).cast("long"), F.least(r, 20 * F.sqrt(n) + 100).cast("long"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    add = lambda s, k: F.struct((s["term"] * (r - k) * (1 - p) / ((n - r + k + 1) * p)).alias("term"), (s["total"] + s["term"]).alias("total"))
    return F.least(F.lit(1.0), at * F.aggregate(steps, start, add, lambda s: s["total"]))


def good_rows(measured: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows that pass the base rule and whose id is labelled 1 and nothing else."""
    told = labels.select(labels[key].cast("long").alias("_key"), labels["quality"].alias("_quality")).where("_key IS NOT NULL AND _quality IN (0, 1)")
    told = told.groupBy("_key").agg(F.min("_quality").alias("_least")).where("_least = 1")
    return measured.where(~base_failed()).join(dealt_again(told, "_key"), F.col(key) == F.col("_key"), "left_semi")


def cutoffs(good: DataFrame, stratum: str = "_stratum", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``stratum, rule, step, cutoff, n_good, n_rejected, p_value`` of the strictest proven cutoff of each
    rule in each stratum; a rule of which none is proven has no row."""
    steps = F.array(*(F.struct(F.lit(rule).alias("rule"), _first_step(rule).alias("step")) for rule in LADDERS))
    # One row a stratum, rule and step: sums of what each task has counted.
    counted = good.select(F.col(stratum).alias("stratum"), F.explode(steps).alias("s")).groupBy("stratum", "s.rule", "s.step").agg(F.count("*").alias("rows"))
    ladders = counted.groupBy("stratum", "rule").agg(F.sum("rows").alias("n_good"), F.map_from_entries(F.collect_list(F.struct("step", "rows"))).alias("by_step"))
    ladders = checkpoint(ladders)
    tests = ladders.count()  # strata times rules
    length = F.element_at(F.create_map(*(F.lit(x) for rule, v in LADDERS.items() for x in (rule, len(v[3])))), F.col("rule"))
    cutoff = F.element_at(F.create_map(*(F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for rule, v in LADDERS.items() for x in (rule, list(v[3])))), F.col("rule"))
    before = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0).cast("long"), lambda a, k: a + F.coalesce(F.try_element_at("by_step", k), F.lit(0).cast("long")))
    climbed = ladders.withColumn("step", F.explode(F.sequence(F.lit(1), length))).withColumn("n_rejected", before)
    climbed = climbed.withColumn("p_value", binomial_at_most(F.col("n_rejected"), F.col("n_good"), risk / len(LADDERS)))
    # Counts rise along a ladder and p-values with them: the steps before the first unproven one are the proven ones.
    proven = climbed.where(F.col("p_value") <= error / max(1, tests))
    best = proven.groupBy("stratum", "rule").agg(F.max_by(F.struct("step", "n_good", "n_rejected", "p_value"), "step").alias("b"))
    return best.select("stratum", "rule", "b.step", F.get(cutoff, F.col("b.step") - 1).alias("cutoff"), "b.n_good", "b.n_rejected", "b.p_value")


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row per document: ``key``, the measures, ``base_failed``, ``failed`` (the rule that rejects
    it, ``base`` before the others) and ``kept``."""
    rows = docs.select(docs[key].cast("long").alias(key), docs[stratum].cast("string").alias("_stratum"), docs[text].alias("_text"))
    measured = checkpoint(measures(rows, "_text").select(key, "_stratum", *MEASURES))
    found = checkpoint(cutoffs(good_rows(measured, labels, key), risk=risk, error=error))
    wide = found.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == rule, F.col("step"))).alias(f"_{rule}") for rule in LADDERS))
    # Both sides of a join that is not broadcast are dealt out by it, so that a large stratum can be split.
    wide = F.broadcast(wide) if wide.count() <= BROADCAST_STRATA else wide.withColumn("stratum", F.concat("stratum", F.lit("")))
    judged = measured.join(wide, F.col("_stratum").eqNullSafe(F.col("stratum")), "left").withColumn("base_failed", base_failed())
    failed = F.when(F.col("base_failed"), "base")
    for rule in LADDERS:
        failed = failed.when(_first_step(rule) <= F.col(f"_{rule}"), rule)
    return judged.withColumn("failed", failed).select(key, *MEASURES, "base_failed", "failed", F.col("failed").isNull().alias("kept"))
