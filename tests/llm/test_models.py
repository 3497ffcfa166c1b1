import math
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from quirelight.llm import lm, mixing, quality

DATA = "/root/testdata/sf0.001"


def water(sizes, weights, share=1.5, most=2):
    total, left = share * sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while left:
        level = total / sum(weights[i] for i in left)
        over = {i for i in left if level * weights[i] >= most * sizes[i]}
        if not over:
            for i in left:
                out[i] = level * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            total -= out[i]
        left -= over
    return out


def test_targets(spark):
    rng = np.random.default_rng(7)
    for _ in range(5):
        sizes = [int(s) for s in rng.integers(0, 2000, 7)]
        names = sorted(["b", "B", "é", "z", "zz", "", None], key=lambda x: (x is None, (x or "").encode()))
        rows = spark.createDataFrame(list(zip(names, sizes))[::-1], "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(rows, (3, 1, 2), 1.5, 2).collect()}
        wanted = water(sizes, [(3, 1, 2)[i % 3] for i in range(7)])
        assert all(math.isclose(got[n], w, rel_tol=1e-9, abs_tol=1e-9) for n, w in zip(names, wanted))


def test_plan(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mixing.plan(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert sum(r.size for r in own) == own[0].source_size and abs(sum(r.taken for r in own) - own[0].target) <= 0.5
    again = mixing.plan(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    copies = [(d.copy, r.doc_id) for r in rows for d in r.draws]
    assert len(copies) == len(set(copies)) and len({d.shard for r in rows for d in r.draws}) > 32


def test_mix_rows_hold_the_words(spark, awkward, empty):
    drawn = {}
    for r in mixing.plan(awkward).collect():
        drawn[r.doc_id] = drawn.get(r.doc_id, 0) + r.taken
    mixed = mixing.mix(awkward)
    assert mixed.columns == [*awkward.columns, "mix_shard"]
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert {k: v for k, v in drawn.items() if v} .keys() == words.keys()
    assert words[3] == drawn[3] and 1 not in words and 2 not in words
    assert mixing.mix(empty).count() == 0 and mixing.plan(empty).count() == 0


def test_mix_takes_what_the_plan_says_of_repeated_rows(spark):
    text = "ten  words\nthat\tmake one text of some ten of them"
    docs = spark.createDataFrame([(1, text, "a")] * 50 + [(2, "others " * 10, "b")] * 30, "doc_id long, text string, source string")
    planned = {r.source: r.n for r in mixing.plan(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    rows = mixing.mix(docs).collect()
    for source, n in planned.items():
        assert sum(len(r.text.split()) for r in rows if r.source == source) == n
    # A cut text keeps its white space.
    assert all(text.startswith(r.text) for r in rows if r.source == "a") and any(r.text != text for r in rows if r.doc_id == 1)


def test_clashing_names(spark, awkward):
    clash = awkward.withColumns({c: F.lit(1) for c in ("id", "y", "body", "own_rest", "own_block", "block_words", "block_source", "draws_of_mix", "shard_of_mix", "spread_of_mix", "starts")})
    assert sorted(map(str, mixing.mix(clash).select(*awkward.columns).collect())) == sorted(map(str, mixing.mix(awkward).select(*awkward.columns).collect()))
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    assert sorted(map(str, quality.classify(clash, labels).collect())) == sorted(map(str, quality.classify(awkward, labels).collect()))
    assert quality.keep(clash, quality.fit(clash, labels)).columns == clash.columns


def test_rows_without_ids_are_spread_over_blocks(spark):
    rows = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.lit("a").alias("source"))
    blocks = mixing._sized(rows, "source", "text", "doc_id").groupBy(F.pmod(F.xxhash64(F.lit(7), "spread_of_mix"), F.lit(8))).count().collect()
    assert len(blocks) == 8 and max(r["count"] for r in blocks) < 1000
    assert abs(mixing.plan(rows).agg(F.sum("taken")).first()[0] - 1.5 * 18000) <= 3


def test_leaves_are_cut_into_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_LEAVES", 4)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    shards = {d.shard for r in mixing.plan(docs, shards=16).collect() for d in r.draws}
    assert len(shards) > 12 and max(shards) < 16
    wide = {d.shard for r in mixing.plan(docs, shards=4).collect() for d in r.draws}
    assert wide == {s // 4 for s in shards}


def test_hypergeometric(spark):
    draws = [r[0] for r in spark.range(4000).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(25), mixing._uniform(F.lit(3), F.col("id")))).collect()]
    wanted = np.random.default_rng(0).hypergeometric(20, 30, 25, 4000)
    assert abs(np.mean(draws) - 10) < 0.15 and abs(np.std(draws) - wanted.std()) < 0.1


def test_network_gradients():
    rng = np.random.default_rng(0)
    texts = [b"plain words here " * 40, b"$$$ ### !!! " * 70, b"", b"x" * 300]
    labels, weights = np.array([1.0, 0, 1, 0]), np.ones(4)
    net = quality.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        s = net.scores(texts)
        return -(labels * np.log(s) + (1 - labels) * np.log(1 - s)).mean()

    grads = net.gradients(texts, labels, weights)
    for k, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        e = 1e-5
        net.p[k][i] += e
        a = loss()
        net.p[k][i] -= 2 * e
        b = loss()
        net.p[k][i] += e
        assert math.isclose(g[i], (a - b) / (2 * e), rel_tol=2e-2)


def test_scores_do_not_depend_on_company():
    net = quality.Network()
    texts = [b"some words " * n for n in (0, 1, 30, 700, 12000)]
    together = net.scores(texts)
    assert np.allclose(together, [net.scores([t])[0] for t in texts], atol=1e-5)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert right / len(rows) > 0.93
    kept = [r for r in rows if r.quality == 1]
    assert sum(r.predicted for r in kept) / len(kept) > 0.93


def test_sample_is_bounded_and_does_not_depend_on_order(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 40, f"{'good words' if i % 2 else '#$%'} {i} " * 20) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    nets = [quality.fit(d, labels) for d in (docs, docs.orderBy(F.desc("text")).repartition(7))]
    assert all(np.array_equal(nets[0].p[k], nets[1].p[k]) for k in nets[0].p)
    monkeypatch.setattr(quality, "TRAIN_BYTES", 3000)
    assert not np.array_equal(quality.fit(docs, labels).p["out"], nets[0].p["out"])


def test_classifier_of_awkward_rows(spark, awkward, empty):
    none = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    rows = quality.classify(awkward, none).collect()
    assert len(rows) == 9 and {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {0}
    assert quality.keep(awkward, quality.fit(awkward, none)).count() == 9
    net = quality.Network()
    assert quality.score(awkward, net).count() == 9 and quality.keep(awkward, net, 0.0).columns == awkward.columns
    assert quality.score(empty, net).count() == 0


def test_word_slots():
    slots, counts = lm.word_slots([b"The cat", b"", b"  the\tCAT \n the", b"\x0b"])
    assert counts.tolist() == [2, 0, 3, 0] and slots[0] == slots[2] == slots[4] and slots[1] == slots[3] != slots[0]


@pytest.mark.parametrize("keys", [[], [0], [2**64 - 1], [5, 6], [0, 2**64 - 1], list(range(10**15, 10**15 + 70000, 7))])
def test_keys_survive_packing(keys):
    own = np.array(keys, np.uint64)
    assert np.array_equal(lm.unpack_keys(lm.pack_keys(own)), own)


def test_lm_network_gradients():
    rng = np.random.default_rng(1)
    net = lm.Network(rng.integers(0, 50, lm.OUTSIDE).astype(float))
    net.p = {k: (v + rng.standard_normal(v.shape) * 0.1).astype(np.float64) for k, v in net.p.items()}
    places = rng.integers(0, lm.OUTSIDE, 30)
    around = lm.windows(places, np.array([1, 0, 20, 9]))
    rows = around - np.arange(4) * (lm.OUTSIDE + 1)
    assert rows[0].tolist() == [lm.OUTSIDE] * 4 and rows[2].tolist() == [lm.OUTSIDE, places[1], places[3], places[4]]
    grads = net.gradients(places, around)
    rows, values = grads["embed"]
    grads["embed"] = np.zeros_like(net.p["embed"])
    grads["embed"][rows] = values
    for k, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        losses = []
        for e in (1e-4, -2e-4):
            net.p[k][i] += e
            losses.append(-net.logs(places, around).mean())
        net.p[k][i] += 1e-4
        assert math.isclose(g[i], (losses[0] - losses[1]) / 2e-4, rel_tol=1e-3)


def test_lm_network_learns_what_stands_two_words_away(spark):
    # A word tells the one two places on; one word to each side tells nothing.
    rng = np.random.default_rng(2)
    texts = []
    for i in range(600):
        row = rng.integers(0, 40, 2).tolist()
        while len(row) < 200:
            row.append((row[-2] * 7 + 3) % 40 if rng.random() < 0.8 else int(rng.integers(0, 40)))
        texts.append(" ".join(f"w{x}" for x in row))
    docs = spark.createDataFrame(list(enumerate(texts[:500])), "doc_id long, text string").repartition(4)
    model = lm.fit(docs)
    ids, counts = lm.word_slots([t.encode() for t in texts[500:]])
    places = lm.places_of(ids, model.top)
    held_out = model.network.logs(places, lm.windows(places, counts)).mean()
    unigram = np.log(model.totals[0][places] / model.totals[0].sum()).mean()
    assert unigram < -3.6 and held_out > -2.6
    # Probabilities of all places add up to one.
    every = np.arange(lm.OUTSIDE)
    assert math.isclose(np.exp(model.network.logs(every, np.tile(lm.windows(places, counts)[:1], (len(every), 1)))).sum(), 1, rel_tol=1e-4)


def test_lm_scores(spark, awkward, empty):
    model = lm.fit(awkward)
    rows = lm.score(awkward, model).collect()
    null = next(r for r in rows if r.doc_id == 1)
    assert len(rows) == 9 and (null.n_words, null.log_prob, null.mean_log_prob) == (0, 0.0, None)
    by_hand = {r.doc_id: r for r in rows}
    s, n = model.scores([b"one text", "日本語 ⅷ é́ 😀 <|endoftext|> it's".encode()])
    # As a new text it finds its own words among the documents counted.
    assert n[1] == by_hand[7].n_words and s[1] > by_hand[7].log_prob
    assert lm.score(empty).count() == 0


def test_lm_tells_neighbours_of_rare_words_apart(spark):
    # More words than the network has classes, all of one frequency: only exact pairs tell them apart.
    docs = spark.createDataFrame([(i, f"left{i} right{i}") for i in range(400)] + [(i, "the end") for i in range(400, 440)], "doc_id long, text string")
    model = lm.fit(docs)
    seen, n = model.scores([f"left{i} right{i}".encode() for i in range(100)])
    swapped, _ = model.scores([f"left{i} right{(i + 16) % 400}".encode() for i in range(100)])
    assert (n == 2).all() and (seen > swapped + 1).all()


def test_lm_scores_by_brute_force(spark):
    """Sums of conditional log-probabilities, with words of their own places and with shared ones."""
    texts = ["a b c", "a b", "B c  a", "", "d", "x" * 300 + "yz x", "x" * 300 + "zy x", " ".join(f"h{i}" for i in range(lm.OWN + 100))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm.fit(docs)
    words = [t.lower().split() for t in texts]
    of = Counter(w for t in words for w in t)
    pairs = Counter(p for t in words for p in zip([None, *t], [*t, None]))
    follows = Counter(a for t in words for a, b in zip([None, *t], t))
    precedes = Counter(b for t in words for a, b in zip(t, [*t[1:], None]))
    ids = {w: int(lm.word_slots([w.encode()])[0][0]) for w in of}
    assert len(set(ids.values())) == len(of) and model.texts == 7
    place = {w: int(lm.places_of(np.array([i], np.uint64), model.top)[0]) for w, i in ids.items()} | {None: lm.OUTSIDE}
    p = {k: v.astype(np.float64) for k, v in model.network.p.items()}

    def softmax(z):
        return np.exp(z) / np.exp(z).sum()

    def by_hand(own, at):
        # Other texts only.
        left, right = [None, *own], [*own, None]
        mine, my_pairs = Counter(own), Counter(zip(left, right))
        my_follows, my_precedes = Counter(left), Counter(right)
        word = lambda i: own[i] if 0 <= i < len(own) else None
        l, w, r = word(at - 1), own[at], word(at + 1)
        h = np.tanh(p["hidden"] + sum(p["embed"][place[word(at + d)] + k * (lm.OUTSIDE + 1)] for k, d in enumerate((-2, -1, 1, 2))))
        g, s = divmod(place[w], lm.PLACES)
        base = softmax(h @ p["group"] + p["group_bias"])[g] * softmax(h @ p["place"][g] + p["place_bias"][g])[s]
        if place[w] >= lm.OWN:
            n, types = model.totals[:, place[w]]
            base *= (of[w] - mine[w] + 0.5) / (n + 0.5 * (types + 1))
        before = (pairs[l, w] - my_pairs[l, w] + lm.PRIOR * base) / (follows[l] - my_follows[l] + lm.PRIOR)
        after = (pairs[w, r] - my_pairs[w, r] + lm.PRIOR * base) / (precedes[r] - my_precedes[r] + lm.PRIOR)
        return math.log(0.5 * before + 0.5 * after)

    for row in lm.score(docs, model).collect():
        own = words[row.doc_id]
        assert row.n_words == len(own)
        assert math.isclose(row.log_prob, sum(by_hand(own, i) for i in range(len(own))), rel_tol=1e-5, abs_tol=1e-9)


def test_lm_training_is_the_same_in_however_many_tasks(spark):
    """Four equal partitions, trained on in one worker after another, average to the training of one."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.4, 80) % 300) for _ in range(60)]
    in_parts = lambda n: spark.createDataFrame(spark.sparkContext.parallelize([(t,) for _ in range(n) for t in texts], n), "text string")
    one, four = in_parts(1), in_parts(4)
    assert four.rdd.getNumPartitions() == 4
    top, totals = lm._vocabulary(lm._word_counts(one, "text"))
    trained = [lm._trained(d, "text", top, lm.Network(totals[0])).p for d in (one, four, one)]
    start = lm.Network(totals[0]).p
    for k in start:
        assert np.array_equal(trained[0][k], trained[2][k]) and np.allclose(trained[0][k], trained[1][k], atol=1e-5)
    assert max(np.abs(trained[0][k] - start[k]).max() for k in start) > 0.05


def test_lm_ranks_junk_and_shuffled_text_low(spark):
    """Strings that no other document has, and sentences out of order, score below prose of the same words."""
    rng = np.random.default_rng(6)
    after = rng.permutation(400)

    def prose():
        out = [int(rng.integers(400))]
        while len(out) < 120:
            out.append(int(after[out[-1]]) if rng.random() < 0.8 else int(rng.integers(400)))
        return [f"w{k}" for k in out]

    rows = [(i, " ".join(prose())) for i in range(400)]
    rows += [(1000 + i, " ".join(rng.permutation(prose()))) for i in range(10)]
    rows += [(2000 + i, " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 12)) for _ in range(120))) for i in range(10)]
    found = {r.doc_id: r.mean_log_prob for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    group = lambda a, b: [v for k, v in found.items() if a <= k < b]
    assert max(group(1000, 2000)) < np.quantile(group(0, 1000), 0.02) and max(group(2000, 3000)) < min(group(0, 2000)) - 1


@pytest.mark.parametrize("stage", range(4))
def test_pipeline_stages_keep_columns(spark, awkward, stage, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = awkward.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    out = pipeline.STAGES[stage][1](spark, docs, DATA)
    assert out.dtypes == docs.dtypes
    out.collect()


def test_pipeline_of_empty_and_awkward_tables(spark, awkward, empty, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for name, rows in (("empty", empty), ("awkward", awkward)):
        docs = rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = pipeline.run(spark, f"{tmp_path}/{name}")
        assert (out.count() == 0) == (name == "empty")
    assert pipeline.token_stage(spark, docs, DATA).count() == 9


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    out = pipeline.run(spark, DATA)
    assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() > 50


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark, empty):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c, d = ("one text about the sea and its ships", "another text on hills and their sheep", "a third one of rivers and old mills", "the fourth tells of winter and snow")
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "y"), (2, a, "x"), (None, a, "x"), (None, b, "x"), (None, b, "x"), (None, c, "x"), (1, d, "x"), (3, d, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pipeline.near_duplicate_stage(spark, docs, DATA).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("1", a), ("None", b), ("None", c), ("1", d)])
    assert pipeline.near_duplicate_stage(spark, empty, DATA).count() == 0
