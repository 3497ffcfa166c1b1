import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from quirelight.llm import quality_rules
from quirelight.llm.queries import op12_quality_rules
from quirelight.llm.quality_rules_sql import SQL
from places import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    """The definitions, word for word."""
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return (len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(repeated))


def test_measures(spark, awkward):
    texts = ["a a a", "a a a a", "a b c x a b c", "a b c a b c", "a b c b c a b c", "x\ny\nx\n \n \n x\nx ", "#1 <b>&|%$*</b>", "Ünï çöde 😀 😀 ü", "a b c d", " ".join(f"w{i % 700}" for i in range(30000)), "ab c ab c", "a b\x1fc"]
    docs = awkward.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True)
    rows = quality_rules.measures(docs).select("text", *quality_rules.MEASURES).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r)[1:] == counts(r.text), (r.text or "")[:40]


@pytest.mark.parametrize("n,r,p", [(1, 0, 0.5), (10, 10, 0.3), (599, 1, 0.0125), (3300, 17, 0.0125), (40, 39, 0.9), (100000, 950, 0.01)])
def test_binomial_bound(spark, n, r, p):
    # Terms as exact integers, scaled down only at the end.
    q = round(p * 10000)
    exact = sum(comb(n, k) * q**k * (10000 - q) ** (n - k) for k in range(r + 1)) if n < 5000 else None
    got = spark.range(1).select(quality_rules.binomial_at_most(F.lit(r), F.lit(n), p)).first()[0]
    if exact is not None:
        assert got == pytest.approx(float(exact * 10**30 // 10000**n) / 10**30, rel=1e-9)
    else:
        from math import exp, lgamma, log, log1p

        assert got == pytest.approx(sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p)) for k in range(r + 1)), rel=1e-6)


def planted(spark, n):
    """n good documents a language, 2 % of the first language's with symbols, and bad ones full of them."""
    word = lambda i: " ".join(f"w{10000 + (i * 31 + k * k) % 9973}" for k in range(60))
    good = [(i, word(i) + (" # #" if lang == "a" and i % 50 == 0 else ""), lang) for j, lang in enumerate(["a", "b", None]) for i in range(j * n, (j + 1) * n)]
    bad = [(10**6 + i, word(i) + " #" * 40, lang) for i, lang in enumerate(["a", "b", None] * 5)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good] + [(i, 0, 0) for i, _, _ in bad], "doc_id long, quality int, toxic int")
    return docs, labels, n


def test_cutoffs_hold_the_risk(spark):
    docs, labels, n = planted(spark, 900)
    out = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    # 40 of 62 words: rejected everywhere, and by the rule of symbols.
    assert all(out[10**6 + i].failed == "symbols" for i in range(15))
    # Of "a" 2 % have 2 symbols in 62 words, above the share of a rule: its cutoff stays above 3 in 100.
    assert all(r.kept for i, r in out.items() if i < 10**6)
    rows = docs.select("doc_id", F.col("lang").alias("_stratum"), "text")
    found = {(r.stratum, r.rule): r for r in quality_rules.cutoffs(quality_rules.good_rows(quality_rules.measures(rows), labels)).collect()}
    assert found["a", "symbols"].cutoff == 5 and found["b", "symbols"].cutoff == 1 == found[None, "symbols"].cutoff
    assert all(r.n_good == n and r.p_value <= quality_rules.ERROR / 12 for r in found.values())
    # An equal share of rejected documents needs a larger sample to be proven: with few, there is no rule.
    few, few_labels, _ = planted(spark, 40)
    assert all(r.kept for r in quality_rules.judge(few, few_labels).collect())


def test_false_rejection_on_other_documents(spark):
    """Cutoffs of one half of the labelled good documents, judged on the other half."""
    docs, labels = (spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.1')}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    out = quality_rules.judge(docs, half).join(labels.where("doc_id % 2 = 1 AND quality = 1"), "doc_id").where("NOT base_failed")
    row = out.agg(F.count("*"), F.avg((~F.col("kept")).cast("int"))).first()
    assert row[0] > 1000 and row[1] < 0.02


def test_edge_cases(spark, awkward, empty):
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, 7), (6, None)], "doc_id long, quality int")
    out = quality_rules.judge(awkward, labels).collect()
    assert len(out) == awkward.count() and all(r.base_failed and r.failed == "base" and not r.kept for r in out)
    clash = awkward.withColumns({c: F.lit(1) for c in ("_words", "_stratum", "stratum", "n_words", "kept", "failed", "quality", "_key", "step")})
    assert sorted(map(str, quality_rules.judge(clash, labels).collect())) == sorted(map(str, out))
    assert quality_rules.judge(empty, labels).count() == 0
    assert quality_rules.judge(awkward, labels.limit(0)).count() == len(out)


def test_query_against_sql(spark, duck):
    """With labels enough for cutoffs, and as the query is registered."""
    docs, labels, _ = planted(spark, 900)
    import duckdb

    con = duckdb.connect()
    for name, df in (("documents", docs), ("labels", labels)):
        con.register(name, df.toPandas())
    ours = sorted(map(tuple, quality_rules.judge(docs, labels).collect()))
    assert ours == sorted(con.execute(SQL).fetchall())
    plan = op12_quality_rules(spark, DATA)
    assert sorted(map(tuple, plan.collect())) == sorted(duck.execute(SQL).fetchall())
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())
