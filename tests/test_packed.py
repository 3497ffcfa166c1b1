"""Registries in binary records and databases give what registries of texts give."""

import os
import sqlite3
import struct

import pytest
import xxhash
from places import DATA
from pyspark.sql import functions as F

from quirelight import recognition_queries as rq
from quirelight.carriers import composed, table
from quirelight.functions import hashed
from quirelight.operators import lookup
from quirelight.plans import recognize as plan
from quirelight.sources import packed, registries, requests


def seed0(text):
    return xxhash.xxh64_intdigest(text.encode(), 0)


def test_keys(spark):
    # A published value: XXH64 of nothing with seed 0.
    assert hashed.hash_key("") == "ef46db3751d8e999"
    rows = spark.createDataFrame([("",), ("brown",), ("ñandú",), (None,)], "t string")
    found = rows.select("t", hashed.hash_key_of(F.col("t")).alias("k"), hashed.key_of_hash(hashed.signed_hash_of(F.col("t"))).alias("again")).collect()
    assert all(r.k == r.again == (None if r.t is None else f"{seed0(r.t):016x}") for r in found)


@pytest.mark.parametrize("split", ["1", "100", "33554432"])
def test_records_by_ranges(spark, tmp_path, split):
    packed.register(spark)
    body = b"".join(struct.pack("<QIII", seed0(f"w{i % 50}"), i, 2**32 - 1, 0) for i in range(90))
    (tmp_path / "word.dat").write_bytes(body + b"\1\2\3")  # an incomplete record
    read = spark.read.format(packed.RECORDS).options(kind="words", splitBytes=split).load(str(tmp_path / "word.dat"))
    assert read.rdd.getNumPartitions() == {"1": 90, "100": 18, "33554432": 1}[split]
    assert sorted(tuple(r)[1:] for r in read.collect()) == [(i, 2**32 - 1, 0) for i in range(90)]
    found = {r.word_key: (r.a, r.b, r.c) for r in packed.read_words(spark, f"file:{tmp_path}/word.dat").collect()}
    assert found == {f"{seed0(f'w{i}'):016x}": (i + (i + 50 if i < 40 else 0), (2**32 - 1) * (2 if i < 40 else 1), 0) for i in range(50)}


def test_journals_written_and_read(spark, tmp_path):
    path = str(tmp_path / "out")
    names = spark.createDataFrame([("annalsofpages",), ("annalsofpages",), ("ñ",), (None,)], "name_key string").repartition(3)
    for _ in range(2):  # written again, there is one copy
        packed.write_journals(names, path)
    assert sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path)) == 24
    assert not [f for f in os.listdir(path) if f.startswith("_")]
    assert {r.name_key for r in packed.read_journals(spark, path).collect()} == {hashed.hash_key("annalsofpages"), hashed.hash_key("ñ")}
    texts = spark.createDataFrame([(1, "x; Annals of Pages 7"), (2, "Annals of Nothing")], "doc_id long, text string")
    assert [tuple(r) for r in lookup.last_journal(texts, packed.read_journals(spark, path), hashed=True).collect()] == [(1, "Annals of Pages")]
    packed.write_journals(names.limit(0), path)
    assert packed.read_journals(spark, path).count() == 0


def test_counts_that_do_not_fit_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="does not fit"):
        packed.write_words(spark.createDataFrame([("w", 2**32, 0, 0)], "word_key string, a long, b long, c long"), str(tmp_path / "w"))
    assert not [f for f in os.listdir(tmp_path / "w") if f.startswith("part")] if os.path.exists(tmp_path / "w") else True


def _database(path, rows):
    signed = lambda v: v - 2**64 if v >> 63 else v
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE doidata (th INTEGER, l1 INTEGER, h1 INTEGER, l2 INTEGER, h2 INTEGER, doi TEXT)")
        for title, a1, a2, doi in rows:
            part = lambda a: (len(a.encode()), seed0(a) >> 32) if a else (0, 0)
            length, top = part(a1)
            # Hashes may be stored with a sign or without.
            db.execute("INSERT INTO doidata VALUES (?, ?, ?, ?, ?, ?)", (None if title is None else signed(seed0(title)), length, top - 2**32 if top >> 31 else top, *part(a2), doi))
    db.close()


def test_a_database_as_it_is(spark, tmp_path):
    path = str(tmp_path / "doidata.sqlite")
    many = [("often", "brown", None, f"10.1/{i}") for i in range(6)]
    _database(path, [("first", "nobody", "brown", "10.1/a"), ("first", "brown", None, "10.1/b"), *many, ("second", "lee", "ng", "10.1/short"), ("third", "grey", None, "10.1/" + "x" * 600), ("fourth", "ends", None, "10.1/c"), (None, None, None, "10.1/only")])
    packed.register(spark)
    split = spark.read.format(packed.DATABASE).options(splitRows="5").load(path)
    assert split.rdd.getNumPartitions() == 3 and split.count() == 12 and {r.ord for r in split.collect()} == set(range(1, 13))
    dois = packed.read_dois(spark, path)
    assert dois.columns == ["doi"] and dois.where("doi = '10.1/only'").count() == 1
    texts = spark.createDataFrame([(1, "bybrowngreyleeandends")], "doc_id long, norm_text string")
    titles = ("first", "often", "second", "third", "fourth", "none")
    asked = spark.createDataFrame([(1, n, hashed.hash_key(t)) for n, t in enumerate(titles)], "doc_id long, cand int, title_key string")
    # Five entries at most, authors of four bytes at least that end before the text, DOIs of bounded length.
    assert [tuple(r) for r in lookup.lookup_titles(asked, packed.read_titles(spark, path), texts).collect()] == [(1, 0, "10.1/a")]


def test_databases_written_and_read(spark, tmp_path):
    path = str(tmp_path / "db")
    rows = [(f"title{i % 40}", "brown" if i % 2 else None, "ü" * 200 if i % 3 else "lee", f"10.1/{i}", i) for i in range(100)] + [(None, None, None, "10.1/only", 0)]
    titles = spark.createDataFrame(rows, "title_key string, author1_key string, author2_key string, doi string, ord long")
    packed.write_titles(titles, path, 3)
    found = packed.read_titles(spark, path).collect()
    assert len(found) == 101 and {r.doi for r in packed.read_dois(spark, path).collect()} == {r[3] for r in rows}
    by_doi = {r.doi: r for r in found}
    for title, a1, a2, doi, _ in rows:
        r = by_doi[doi]
        assert r.title_key == (hashed.hash_key(title) if title else None)
        assert (r.author1_len, r.author1_hash) == ((5, seed0("brown") >> 32) if a1 else (0, 0))
        assert r.author2_len == (0 if a2 is None or len(a2) > 100 else 3)
    # Entries of one title keep their order.
    for k in range(40):
        mine = sorted((r for r in found if r.title_key == hashed.hash_key(f"title{k}")), key=lambda r: r.ord)
        assert [int(r.doi[5:]) for r in mine] == sorted(int(r.doi[5:]) for r in mine)


def test_authors_end_before_the_text():
    assert hashed.author_in(b"xbrownx", 5, seed0("brown") >> 32)
    assert not hashed.author_in(b"xbrown", 5, seed0("brown") >> 32)
    assert not hashed.author_in(b"xleex", 3, seed0("lee") >> 32) and not hashed.author_in(b"ab", 9, 1) and not hashed.author_in(b"abcdef", None, None)


@pytest.mark.parametrize("buckets", [None, 4])
def test_recognition_is_the_same(spark, tmp_path, buckets):
    docs = table(spark, DATA, "documents").select("doc_id", "text", "source")
    sent = composed(docs, rq._full_request, "text", "source").persist()
    journals = docs.select(F.concat(F.lit("journalof"), F.translate(F.coalesce("source", F.lit("none")), rq._DIGITS, rq._LETTERS), F.lit("studies")).alias("name_key"))
    titles, words = rq._registry(docs), rq._dictionary(spark)
    packed.write_titles(titles, str(tmp_path / "t"))
    packed.write_journals(journals, str(tmp_path / "j"))
    packed.write_words(words, str(tmp_path / "w"))
    ours = registries.prepare(packed.read_titles(spark, str(tmp_path / "t")), packed.read_journals(spark, str(tmp_path / "j")), packed.read_words(spark, str(tmp_path / "w")), buckets)
    assert ours.hashed
    found = requests.to_result_json(plan.recognize_with(sent, ours)).collect()
    texts = requests.to_result_json(plan.recognize(sent, titles, registries.journal_set(journals), words)).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, texts)) and sum('"doi"' in r.result for r in found) > 50
