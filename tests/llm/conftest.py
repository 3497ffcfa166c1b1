import os
import tempfile

import pytest


@pytest.fixture(scope="session", autouse=True)
def _checkpoints(spark):
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ck-"))


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return os.environ.get("QUIRELIGHT_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")


#: Nulls, empty and long texts, repeated rows and columns whose names clash with inner ones.
AWKWARD = [
    (1, None, None), (2, "", "a"), (3, "word " * 20000, "a"), (4, "Same Text here for all to see\nx", None), (4, "Same Text here for all to see\nx", None),
    (5, "same text HERE for all to see\nx", "b"), (None, "Same Text here for all to see\ny", "b"), (6, " \t\n\x0b\x0c\r ", "c"), (7, "日本語 ⅷ é́ 😀 <|endoftext|> it's", "c"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, s, "en", 1, 2, 3) for i, t, s in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, key int, doc int, fp int")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
