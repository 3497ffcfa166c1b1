"""The plan, malformed input, files and the stream."""

import gzip
import json
import re

from pyspark.sql import functions as F

from quirelight.functions import text
from quirelight.operators import lookup
from quirelight.plans.recognize import facts, known_facts, recognize, recognized
from quirelight.sources import requests
from quirelight.sources.registries import prepare
from quirelight.streaming.recognize import read_stream, recognize_stream


def word(text, x, y, size=10, font=1):
    return [x, y, x + 5 * len(text), y + size, size, 1, y + size - 2, 0, 0, 0, 0, 0, font, text]


def block(text, y, size=10, font=1):
    words, x = [], 72
    for t in text.split(" "):
        words.append(word(t, x, y, size, font))
        x += 5 * len(t) + 5
    return [72, y, x, y + size, [[words]]]


def payload(*blocks, title=None, pages=1):
    page = [612, 792, [[list(blocks)]]]
    return json.dumps({"metadata": {"Title": title} if title else {}, "totalPages": pages, "pages": [page] * pages})


def registries(spark):
    registry = spark.createDataFrame([("astudyofpages", "brown", None, "10.1000/t", 1)], "title_key string, author1_key string, author2_key string, doi string, ord long")
    journals = spark.createDataFrame([("annalsofpages",)], "name_key string")
    words = spark.createDataFrame([("ann", 0, 5, 0)], "word_key string, a long, b long, c long")
    return registry, journals, words


def run(spark, bodies):
    rows = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, body string")
    return {r.doc_id: r for r in recognize(rows, *registries(spark)).collect()}


def test_fields_and_malformed_input(spark):
    words = block("see doi:10.1234/ABC. and ISBN 978-0-306-40615-7 arXiv:1234.5678 ISSN 1234-567X by Brown here", 300)
    bodies = [
        payload(block("A Longer Study of the Printed Page", 100, 20), block("Ann Brown, Bob Lee", 140, 12), words),
        payload(block("written by Brown as all know", 300), title="A Study of Pages"),
        "{not json", None, "[1, 2]", "{}", json.dumps({"metadata": {}, "totalPages": 1, "pages": []}), json.dumps({"pages": []}),
    ]
    out = run(spark, bodies)
    assert len(out) == len(bodies)
    first = out[0]
    assert first.title.strip() == "A Longer Study of the Printed Page" and [(a.firstName, a.lastName) for a in first.authors] == [("Ann", "Brown"), ("Bob", "Lee")]
    assert first.doi == "10.1234/ABC." and first.isbn == "9780306406157" and first.arxiv == "1234.5678" and first.issn == "1234-567X"
    assert out[1].doi == "10.1000/t" and out[1].title == "A Study of Pages"
    assert [out[i].malformed for i in range(2, 8)] == [True, True, True, True, False, False]
    assert all(out[i].title is None and out[i].type == "journal-article" for i in range(2, 8))


def test_rows_are_told_apart_whatever_their_ids(spark):
    bodies = [(7, payload(block("A Longer Study of the Printed Page", 100, 20), block("Ann Brown, Bob Lee", 140, 12), block("doi:10.1234/seven", 300))), (7, payload(block("nothing at all", 300))), (None, payload(block("A Shorter Study of the Written Page", 100, 20), block("Ann Lee, Bob Brown", 140, 12), block("doi:10.1234/none", 300)))]
    out = recognize(spark.createDataFrame(bodies, "doc_id long, body string"), *registries(spark)).collect()
    assert sorted((str(r.doc_id), str(r.title).strip(), str(r.doi)) for r in out) == [("7", "A Longer Study of the Printed Page", "10.1234/seven"), ("7", "None", "None"), ("None", "A Shorter Study of the Written Page", "10.1234/none")]


def test_bodies_are_neither_shuffled_nor_parsed_twice(spark):
    rows = spark.createDataFrame([(1, payload(block("Ann", 10)))], "doc_id long, body string")
    assert "Exchange" not in facts(rows)._jdf.queryExecution().executedPlan().toString()
    rest = recognized(known_facts(rows), prepare(*registries(spark)))._jdf.queryExecution().optimizedPlan().toString()
    assert "body" not in rest


def test_short_registered_dois_are_not_trusted(spark):
    registry = spark.createDataFrame([("10.1234/a",), ("10.1234/bc",), ("10.1234/def",)], "doi string")
    texts = [(1, "10.1234/aXYZ"), (2, "10.1234/bcXYZ"), (3, "10.1234/DEFXYZ"), (4, "10.9999/q 10.1234/aXYZ 10.1234/def"), (5, "10.9999/q 10.9999/R"), (6, "10.9999/" + "Q" * 60)]
    found = dict(lookup.extract_doi(spark.createDataFrame(texts, "doc_id long, text string"), registry).collect())
    assert found == {1: "10.1234/aXYZ", 2: "10.1234/bcXYZ", 3: "10.1234/def", 4: "10.1234/aXYZ", 5: "10.9999/R", 6: "10.9999/" + "q" * 60}


def test_columns_and_strings_are_normalised_by_one_rule(spark):
    points = [chr(p) for p in range(1, 0x110000) if not 0xD800 <= p < 0xE000]
    texts = ["".join(points[i : i + 500]) for i in range(0, len(points), 500)] + ["Plain ASCII, 12!", "", "\u0939\u093f\u2167 \u24b6"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for row in rows.select("t", text.normalize(F.col("t")).alias("n")).collect():
        assert row.n == (None if row.t is None else text.normalize_text(row.t))
    assert text.normalize_text(texts[-1]) == "\u0939\u093fviiia"


def test_numbers_and_nesting_beyond_reason(spark):
    huge = json.dumps({"metadata": {}, "totalPages": 10**30, "pages": [[10**400, 792, [[[[0, 0, 1, 1, [[[[10**400] * 13 + ["Ann"]]]]]]]]]]})
    out = run(spark, ["[" * 100000, huge, '{"metadata": {}, "totalPages": 1, "pages": NaN}', '{"metadata": {"Title": "\\ud800"}, "totalPages": 1, "pages": []}'])
    assert [out[i].malformed for i in range(4)] == [True, False, True, True]


def test_command_reads_registries_and_writes_results(spark, tmp_path):
    from quirelight.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(payload(block("written by Brown as all know", 300), title="A Study of Pages"))
    names = []
    for name, df in zip(("titles", "journals", "words"), registries(spark)):
        df.write.parquet(str(tmp_path / name))
        names += [f"--{name}", str(tmp_path / name)]
    for form in ("json", "text", "parquet"):
        main([str(tmp_path / "in"), str(tmp_path / form), *names, "--form", form], spark)
    assert spark.read.json(str(tmp_path / "json")).first().doi == "10.1000/t"
    assert json.loads(spark.read.text(str(tmp_path / "text")).first().value)["title"] == "A Study of Pages"
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 1


def test_jstor_cover_wins(spark):
    lines = ["Cover", "On Pages", "Author(s): Ann Brown and Bob Lee", "Source: Annals, Vol. 3, No. 2 (1999), pp. 1-9", "Published by: Press", "Stable URL: http://www.jstor.org/stable/77"]
    rows = [[[word(t, 72 + 60 * k, 100 + 12 * i) for k, t in enumerate(x.split(" "))]] for i, x in enumerate(lines)]
    body = json.dumps({"metadata": {}, "totalPages": 1, "pages": [[612, 792, [[[[72, 100, 400, 200, rows]]]]]]})
    row = run(spark, [body])[0]
    assert row.doi == "10.2307/77" and row.url == "http://www.jstor.org/stable/77"


def test_decoded_tables(spark):
    rows = spark.createDataFrame([(1, payload(block("one two", 10), pages=2)), (2, "{"), (3, json.dumps({"metadata": {}, "totalPages": 1, "pages": [[1, 2, []]]}))], "doc_id long, body string")
    parsed = requests.parse(rows)
    assert [r.malformed for r in parsed.orderBy("doc_id").collect()] == [False, True, False]
    assert requests.decode_pages(parsed).count() == 3
    assert requests.decode_words(parsed).count() == 4


def test_long_runs_do_not_overflow(spark):
    from pyspark.sql import functions as F

    from quirelight.functions import identifiers, jstor

    long_ = spark.range(1).select(F.repeat(F.lit("word "), 20000).alias("t"))
    assert long_.select(F.size(identifiers.journal_candidates(F.col("t")))).first()[0] == 1
    assert long_.select(jstor.parse_cover(F.concat("t", F.lit("\nStable URL: http://www.jstor.org/stable/7\n"))).alias("j")).first().j.doi == "10.2307/7"


def test_files_and_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(payload(block("Ann", 10)))
    with gzip.open(source / "b.json.gz", "wt") as f:
        f.write(payload(block("Bob", 10)))
    assert requests.read_payloads(spark, str(source)).count() == 2
    query = recognize_stream(read_stream(spark, str(source)), *registries(spark), out=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"), once=True)
    query.awaitTermination(180)
    # What was sent in an earlier batch gives no second result; what is new does.
    (source / "c.json").write_text(payload(block("Ann", 10)))
    (source / "d.json").write_text(payload(block("Cy", 10)))
    query = recognize_stream(read_stream(spark, str(source)), *registries(spark), out=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"), once=True)
    query.awaitTermination(180)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 3 and all(json.loads(r.result)["type"] == "journal-article" for r in out)


def test_bucketed_registries_stay_where_they_are(spark):
    rows = spark.createDataFrame([(1, payload(block("written by Brown as all know", 300), title="A Study of Pages")), (2, payload(block("A Longer Study of the Printed Page", 100, 20), block("Ann Brown, Bob Lee", 140, 12), block("doi:10.1000/tuv", 300)))], "doc_id long, body string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        prepared = prepare(*registries(spark), buckets=4)
        known = known_facts(rows, prepared.registered)
        found = recognized(known, prepared)
        plan = found._jdf.queryExecution().executedPlan().toString()
        results = {r.doc_id: r.doi for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert results == {1: "10.1000/t", 2: "10.1000/tuv"}  # a registered DOI of nine bytes is not trusted
    # Below an exchange stands a scan of the facts, never one of a registry.
    lines = [(m.end(), x) for x in plan.split("\n") if (m := re.match(r"[ :]*[+:]- ", x))]
    scans = [i for i, (_, x) in enumerate(lines) if re.search("FileScan parquet spark_catalog.*(dois|journals|words)_", x)]
    assert len(scans) == 3  # hits of titles are written before
    for i in scans:
        at, above = lines[i][0], []
        for depth, x in reversed(lines[:i]):
            if depth < at:
                at = depth
                above.append(x)
        joins = next(k for k, x in enumerate(above) if "Join" in x)
        assert not any("Exchange" in x for x in above[:joins])


def test_longest_prefixes_are_merged_in_order(spark):
    """Against all prefixes of each match, with ranges so narrow that prefixes fall into earlier ones."""
    import random

    rng = random.Random(4)
    text_ = lambda n: "10." + "".join(rng.choice("ab/é") for _ in range(n))
    dois = sorted({text_(rng.randrange(1, 9)) for _ in range(150)}) + ["10.", "10.a", None]
    rows = [(i % 40, i, rng.choice([text_(rng.randrange(1, 14)), (rng.choice(dois) or "11.").upper() + "Q", "10.A" + "b" * 70])) for i in range(600)] + [(None, 0, "10.aaa")] * 3
    registry = spark.createDataFrame([(d,) for d in dois], "doi string").repartition(3)
    matches = spark.createDataFrame(rows, "doc_id long, match_no int, match string").repartition(3)
    ascii_ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    low = lambda m: m.translate(ascii_)
    best = lambda m: max((d for d in dois if d and len(low(m).encode()) < 64 and low(m).startswith(d)), key=len, default=None)
    expected = sorted((str(i), n, m, str(best(m))) for i, n, m in rows)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = lookup.longest_registered_prefix(matches, registry).collect()
        # One row of each match and DOI is dealt out.
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((str(r.doc_id), r.match_no, r.match, str(r.doi)) for r in found) == expected
    lengths = sorted({len(d) for d in dois if d})
    by_length = lookup.longest_prefix_by_length(matches.where("doc_id IS NOT NULL"), registry, lengths).collect()
    assert sorted((str(r.doc_id), r.match_no, r.match, str(r.doi)) for r in by_length) == [x for x in expected if x[0] != "None"]


def test_bodies_by_content(spark, tmp_path):
    whole = gzip.compress(b'{"a": 1}')
    files = {"plain.gz": b'{"a": 1}', "zipped.json": whole, "cut": whole[:-9], "early": whole[:1], "broken": whole[:8] + b"xxxxxx" + whole[14:], "bytes": b"\xff{}", "inside": gzip.compress(b"\xff"), "empty": b"", "none": gzip.compress(b""), "twice": whole + whole}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = spark.read.format("binaryFile").load(str(tmp_path)).select(F.xxhash64("path").alias("doc_id"), F.substring_index("path", "/", -1).alias("name"))
    found = {r.name: r.body for r in requests.read_contents(spark, str(tmp_path)).join(rows, "doc_id").collect()}
    good = '{"a": 1}'
    # An empty file has no row.
    assert found == {"plain.gz": good, "zipped.json": good, "cut": None, "early": "\x1f", "broken": None, "bytes": None, "inside": None, "none": "", "twice": good}
    assert requests.bodies(spark.createDataFrame([(1, None)], "doc_id long, content binary")).first().body is None


def test_long_streams_are_refused(monkeypatch):
    monkeypatch.setattr(requests, "MOST_UNZIPPED", 1000)
    assert requests.unzipped(gzip.compress(b"x" * 999)) == "x" * 999 and requests.unzipped(gzip.compress(b"x" * 5000)) is None


def test_a_batch_that_runs_again_leaves_one_copy(spark, tmp_path):
    sent = [payload(block("Ann Brown doi:10.1234/ABC", 100)), "{", None]
    results = recognize(spark.createDataFrame(list(enumerate(sent)), "doc_id long, body string"), *registries(spark)).persist()
    for form in ("parquet", "json", "text"):
        path = str(tmp_path / form)
        for batch in ("a", "b", "a"):
            assert requests.write_results(results, path, form, batch) == {"rows": 3, "malformed": 2, "titled": 0, "with_doi": 1}
        # Names of folders are all that a reader needs.
        assert {r.batch: r["count"] for r in spark.read.format(form).load(path).groupBy("batch").count().collect()} == {"a": 3, "b": 3}
        assert requests.write_results(results.limit(0), path, form, "a") == {"rows": 0, "malformed": 0, "titled": 0, "with_doi": 0}
        assert spark.read.format(form).load(path).count() == 6
    assert requests.write_results(results, str(tmp_path / "plain"), "parquet")["rows"] == 3
