import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinespan.llm import tokens
from kinespan.sources.tables import table

FOLDER = "/root/testdata/sf0.001"
ODD = [
    "", " ", "\n\n\n", "a", "<|endoftext|>", "it's we'll they've I'd", "año ñandú 測試 テスト тест", "😀😀 ok", "x" * 300, "    tab\tend ", "a\r\nb\r\n", "é" * 20, "1234567890abc" * 30,
    "\x00\x1c\x85 ​", "  leading and trailing  ", "'s 's''s", "a 'll b", "_ __ ___ a_b__c", "}{)(*&^%$#@!~`",
]


@pytest.fixture(scope="module")
def other():
    found = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    found.encode_special_tokens = True
    return found


def test_same_ids_as_another_library(spark, other):
    docs = table(spark, FOLDER, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)] + [(-1000, None)], "doc_id long, text string")
    rows = docs.unionByName(odd)
    texts = dict(rows.collect())
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.token_ids(rows, "text", ["doc_id"]).collect()}
    assert got.keys() == texts.keys() and got[-1000] == [] and got[-1] == []
    for key, text in texts.items():
        if text:
            assert got[key] == other.encode(text, add_special_tokens=False).ids, (key, text[:40])
    assert got[-5] != [50256]


def test_pieces_do_not_change_ids():
    rng = random.Random(7)
    tokenizer = tokens.encoding(open(f"{tokens.TOKENIZER_DIR}/{tokens.BYTE_BPE_50K}", "rb").read())
    alphabet = ["a", "B", "é", "7", " ", "  ", "\n", "\t", "\r\n", "'s", "'", ".", "_", " ", "測", "😀", "\x1c", "don't", "é"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200)))
        parts = list(tokens.pieces(text, 5))
        assert "".join(parts) == text
        assert [i for p in parts for i in tokenizer.encode_ordinary(p)] == tokenizer.encode_ordinary(text)


def test_very_long_texts(spark):
    long = ["word " * 200_000, "a" * 150_000, "12ab" * 60_000, "\n" * 200_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id int, text string")
    found = tokens.token_ids(df, "text", ["doc_id"])
    back = found.select("doc_id", tokens.texts_of(spark, F.col("ids")).alias("text"))
    assert dict(back.collect()) == dict(enumerate(long))
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()}
    assert counts == {r["doc_id"]: len(r["ids"]) for r in found.collect()}


def test_clashing_names_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", 9, "k"), (1, "a b", 9, "k")], "doc_id int, text string, ids int, _key string")
    found = tokens.token_ids(df)
    assert found.columns == ["doc_id", "_key", "ids"]
    assert [(r["doc_id"], r["_key"], list(r["ids"])) for r in found.collect()] == [(1, "k", [64, 275])] * 2
    assert tokens.token_ids(df.where("false")).count() == 0
