import hashlib
from collections import Counter

import numpy as np
import pytest
import tokenizers.processors
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quirelight.llm import bpe, token_counts


def check(path, texts):
    library, codec = Tokenizer.from_file(path), bpe.Codec.load(path)
    for text, packed in zip(texts, codec.pack(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert codec.unpack(packed) == library.decode(ids, skip_special_tokens=False)


def test_like_the_library(tokenizer, duck):
    check(tokenizer, [t for (t,) in duck.execute("SELECT text FROM documents").fetchall()])


def test_odd_texts(tokenizer):
    check(tokenizer, ["", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "they'll it's", "a" * 3000, " " * 500, "ֈ x\U00013dc8y Ᲊ", "日本語テキスト", "x  \n\n y\t\tz", "12345 １２ ⅷ ²", "\x00\x7f"])


def test_every_token_and_pairs_of_tokens(tokenizer):
    codec = bpe.Codec.load(tokenizer)
    rng = np.random.default_rng(1)
    for a, b in rng.integers(0, 50256, (3000, 2)).tolist():
        word = codec.bytes_of[a] + codec.bytes_of[b]
        assert codec.encode_words([word])[0] == codec.merge(word)


def test_long_words_merge_alike(tokenizer):
    codec = bpe.Codec.load(tokenizer)
    word = b"thesearetherealones" * 20
    small = bpe.SMALL
    try:
        bpe.SMALL = 0
        heap = codec.merge(word[:60])
        bpe.SMALL = 64
        assert heap == codec.merge(word[:60])
    finally:
        bpe.SMALL = small


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    import public_tokenizers

    check(public_tokenizers.path("byte_bpe_50k.json"), [text])


def test_frames(spark, awkward, empty, tokenizer):
    rows = bpe.round_trip(awkward, tokenizer).collect()
    assert len(rows) == 9
    null = next(r for r in rows if r.doc_id == 1)
    assert null.n_tokens == 0 and null.ids_sha256 == null.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    encoded = bpe.encode(awkward, tokenizer)
    decoded = {r.doc_id: r.text for r in bpe.decode(encoded, tokenizer).collect()}
    assert decoded == {r.doc_id: r.text or "" for r in awkward.collect()}
    assert bpe.round_trip(empty, tokenizer).count() == 0


def test_attribution_rules(tokenizer):
    codec = bpe.Codec.load(tokenizer)
    sizes = np.array([len(b) for b in codec.bytes_of])
    text = "hello world\nab"
    (packed,) = codec.pack([text])
    for rule, wanted in (("start", [2, 0, 2]), ("end", [1, 1, 2]), ("majority", [1, 1, 2]), ("split", [1 + 2 / 6, 4 / 6, 2])):
        # " world" is one token over the boundary at 7; "\n" and "ab" follow.
        counts, crossing = token_counts.attribute(text, packed, sizes, np.array([0, 7, 11]), rule)
        assert crossing == 1 and np.allclose(counts, wanted), rule


def test_section_counts(spark, awkward, empty, tokenizer):
    codec = bpe.Codec.load(tokenizer)
    rows = token_counts.section_counts(awkward, tokenizer).collect()
    texts = [r.text or "" for r in awkward.collect()]
    for r, t, packed in zip(rows, texts, codec.pack(texts)):
        assert r.n_tokens == len(packed) // 4 == sum(r.section_tokens) and r.n_sections == t.count("\n") + 1 == len(r.section_tokens)
    by_field = token_counts.section_counts(awkward, tokenizer, fields=["source", "text"], rule="split").collect()
    assert all(abs(sum(r.section_tokens) - r.n_tokens) < 1e-6 and r.n_sections == 2 for r in by_field)
    assert token_counts.section_counts(empty, tokenizer).count() == 0


@pytest.mark.parametrize("rule", ["start", "end", "majority", "split"])
def test_section_counts_by_offsets_of_the_library(spark, tokenizer, rule):
    """The library's own spans, attributed character by character."""
    library = tokenizers.Tokenizer.from_file(tokenizer)
    library.post_processor = tokenizers.processors.ByteLevel(trim_offsets=False)
    library.no_truncation()
    library.no_padding()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in docs} | {-1: "one\n\n\n  two\n日本語\U0001f600\n é́ x\n", -2: "\n\n\n\n", -3: "a\n" * 50}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    crossing = 0
    for r in token_counts.section_counts(rows, tokenizer, rule=rule).collect():
        text = texts[r.doc_id]
        section = np.cumsum([0] + [c == "\n" for c in text[:-1]]) if text else np.zeros(0, int)
        wanted = [0.0] * (text.count("\n") + 1)
        spans = library.encode(text, add_special_tokens=False).offsets
        for a, b in spans:
            touched = Counter(section[a:b].tolist())
            crossing += len(touched) > 1
            if rule == "split":
                for s, n in touched.items():
                    wanted[s] += n / (b - a)
            else:
                s = {"start": min(touched), "end": max(touched), "majority": min(touched, key=lambda s: (-touched[s], s))}[rule]
                wanted[s] += 1
        assert r.n_tokens == len(spans) and np.allclose(r.section_tokens, wanted), (r.doc_id, rule)
    assert crossing > 0
