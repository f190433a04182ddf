"""Token ids of every text by a public byte-level BPE, and back.

The rank file is read once on the driver and broadcast (under 1 MB, checked), so executors need no
copy of it. Rows are encoded where they are scanned; nothing is shuffled.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files lie unless a caller says otherwise.
TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-splitting pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_RANK_BYTES = 16_000_000
#: Longer texts are encoded in pieces of about this many code points.
PIECE = 65_536
#: Ids that a task holds before it passes a batch on.
HELD_IDS = 4_000_000
#: Places where every tokenisation under PATTERN has a token boundary, whatever stands around them:
#: before a blank that follows a visible character, and between an ASCII letter and an ASCII digit.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}\p{S}])(?=[ \n\r\t])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")

_made: dict[int, tiktoken.Encoding] = {}


def rank_file(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The bytes of a rank file (base64 token and rank a line), broadcast."""
    with open(path or f"{TOKENIZER_DIR}/{BYTE_BPE_50K}", "rb") as f:
        ranks = f.read(MAX_RANK_BYTES + 1)
    if len(ranks) > MAX_RANK_BYTES:
        raise ValueError(f"the rank file is larger than {MAX_RANK_BYTES} bytes")
    return spark.sparkContext.broadcast(ranks)


def encoding(ranks: bytes) -> tiktoken.Encoding:
    """The tokenizer of a rank file; made once in a worker."""
    key = hash(ranks)
    if key not in _made:
        pairs = (line.split() for line in ranks.splitlines() if line)
        _made[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _made[key]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """`text` cut at safe boundaries into pieces of at least `size` code points; a run without one stays whole."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(tokenizer: tiktoken.Encoding, text: str | None) -> list[int]:
    """Ids of a text of any length; none for an empty or null one. Special tokens' texts are ordinary text."""
    if not text:
        return []
    if len(text) <= PIECE:
        return tokenizer.encode_ordinary(text)
    return [i for p in pieces(text) for i in tokenizer.encode_ordinary(p)]


def _over_texts(ranks: Broadcast, make: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(ranks.value)
        for batch in batches:
            yield from make(tokenizer, batch)

    return run


def _ids(tokenizer: tiktoken.Encoding, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    flat, ends, first = array("i"), [0], 0

    def out(last: int) -> pa.RecordBatch:
        ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))
        return pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), ids], ["_key", "_ids"])

    for i, text in enumerate(batch.column(1)):
        flat.extend(encode(tokenizer, text.as_py()))
        ends.append(len(flat))
        if len(flat) > HELD_IDS:
            yield out(i + 1)
            flat, ends, first = array("i"), [0], i + 1
    if first < len(batch):
        yield out(len(batch))


def _counts(tokenizer: tiktoken.Encoding, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n = np.fromiter((len(encode(tokenizer, t.as_py())) for t in batch.column(1)), np.int64, len(batch))
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], ["_key", "_n"])


def token_ids(documents: DataFrame, text: str = "text", key: list[str] | None = None, ranks: str | None = None) -> DataFrame:
    """The columns `key` (default: all others) and `ids`, a list of ints, for every row.

    Null and empty texts have an empty list. Repeated rows come out repeated; an empty table gives
    none. Other columns, whatever their names, pass through untouched when they are in `key`; one named
    like the result is replaced by it.
    """
    spark = documents.sparkSession
    key = [c for c in documents.columns if c != text] if key is None else key
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in key]).alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    found = rows.mapInArrow(_over_texts(rank_file(spark, ranks), _ids), f"_key {kind}, _ids array<int>")
    return found.select(*[F.col(f"_key.`{c}`") for c in key if c != "ids"], F.col("_ids").alias("ids"))


def token_counts(documents: DataFrame, text: str = "text", key: list[str] | None = None, ranks: str | None = None, n: str = "n_tokens") -> DataFrame:
    """As `token_ids`, but with the number of ids only."""
    spark = documents.sparkSession
    key = [c for c in documents.columns if c != text] if key is None else key
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in key]).alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    found = rows.mapInArrow(_over_texts(rank_file(spark, ranks), _counts), f"_key {kind}, _n bigint")
    return found.select(*[F.col(f"_key.`{c}`") for c in key if c != n], F.col("_n").alias(n))


def texts_of(spark: SparkSession, ids: Column, ranks: str | None = None) -> Column:
    """The text of a list of ids: their bytes in a row, read as UTF-8. Null for null; ids outside the vocabulary raise KeyError."""
    file = rank_file(spark, ranks)

    @F.pandas_udf("string")
    def decode(lists: pd.Series) -> pd.Series:
        tokenizer = encoding(file.value)
        return lists.map(lambda x: None if x is None else tokenizer.decode_bytes(list(map(int, x))).decode("utf-8", "replace"))

    return decode(ids)
