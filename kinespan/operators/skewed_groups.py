"""Per-key results where a handful of keys holds most rows: dense accumulator arrays.

Rows are never shuffled by key. Every input split adds its rows to dense arrays that are indexed by
the key's code, and only these arrays meet, so a key with a third of all rows costs each split the
same as any other key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespan.workspace import written

#: Keys of an array block.
BLOCK = 4096
#: Array cells that a task holds before it passes blocks on; bounds its memory whatever the number of keys.
CELLS = 4_000_000
#: Dictionaries of at most this many keys are broadcast; larger ones are joined with salted rows.
BROADCAST_KEYS = 100_000
SALTS = 16


def dense_codes(keys: DataFrame, code: str = "code", buckets: int = 64) -> tuple[DataFrame, int]:
    """Distinct rows of `keys` with codes 0..n-1, and n. Null is a key like any other.

    Keys are numbered within hash buckets and the buckets laid end to end, so no task sees all keys.
    The result is a written table: codes stay as they are when a task runs again.
    """
    cols = keys.columns
    bucketed = keys.distinct().withColumn("_bucket", F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int"))
    numbered = written(
        bucketed.withColumn("_nr", F.row_number().over(Window.partitionBy("_bucket").orderBy(*cols)).cast("long") - 1), "codes"
    )
    sizes = {r["_bucket"]: r["n"] for r in numbered.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for b in range(buckets):
        starts.append(total)
        total += sizes.get(b, 0)
    offset = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("_bucket") + 1)
    return numbered.select(*cols, (offset + F.col("_nr")).alias(code)), total


def encoded(df: DataFrame, keys: list[str], dictionary: DataFrame, n_keys: int, spread: list[str]) -> DataFrame:
    """`df` with the `code` of its keys. `spread`: columns by whose hash rows are salted if the dictionary is large."""
    right = dictionary.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "code")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    drop = [f"_k{i}" for i in range(len(keys))]
    if n_keys <= BROADCAST_KEYS:
        return df.join(F.broadcast(right), _all(same)).drop(*drop)
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, _all([*same, F.col("_salt") == F.col("_s")])).drop(*drop, "_salt", "_s")


def _all(conditions: list) -> object:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _value_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one input split: per touched block the rows, usable values, their sum and their minimum by code."""
    held: dict[int, list[np.ndarray]] = {}

    def blocks() -> pd.DataFrame:
        out = pd.DataFrame(
            [(b, *a) for b, a in held.items()], columns=["block", "n_rows", "n_usable", "total", "least"]
        )
        held.clear()
        return out

    for batch in batches:
        if not len(batch):
            continue
        code = batch["code"].to_numpy(np.int64)
        value = batch["value"].to_numpy(np.float64, na_value=np.nan)
        usable = np.isfinite(value) & (value >= 0)
        order = np.argsort(code // BLOCK, kind="stable") if code.max() >= BLOCK else slice(None)
        code, value, usable = code[order], value[order], usable[order]
        which, first = np.unique(code // BLOCK, return_index=True)
        for b, lo, hi in zip(which.tolist(), first, [*first[1:], len(code)]):
            at, ok = code[lo:hi] - b * BLOCK, usable[lo:hi]
            good, kept = at[ok], value[lo:hi][ok]
            if b not in held:
                held[b] = [np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64), np.zeros(BLOCK), np.full(BLOCK, np.inf)]
            n_rows, n_usable, total, least = held[b]
            n_rows += np.bincount(at, minlength=BLOCK)
            n_usable += np.bincount(good, minlength=BLOCK)
            total += np.bincount(good, weights=kept, minlength=BLOCK)
            np.minimum.at(least, good, kept)
        if len(held) * BLOCK * 4 > CELLS:
            yield blocks()
    yield blocks()


def _member_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one split of the members' bit rows: how many members each code of a 64-code word has, as block arrays."""
    held: dict[int, np.ndarray] = {}

    def blocks() -> pd.DataFrame:
        out = pd.DataFrame(list(held.items()), columns=["block", "n_members"])
        held.clear()
        return out

    for batch in batches:
        if not len(batch):
            continue
        word = batch["word"].to_numpy(np.int64)
        bits = np.unpackbits(batch["bits"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, back = np.unique(word, return_inverse=True)
        counts = np.zeros((len(which), 64), np.int64)
        np.add.at(counts, back, bits)
        for w, c in zip(which.tolist(), counts):
            b, at = divmod(w * 64, BLOCK)
            held.setdefault(b, np.zeros(BLOCK, np.int64))[at : at + 64] += c
        if len(held) * BLOCK > CELLS:
            yield blocks()
    yield blocks()


def dense_group_statistics(df: DataFrame, keys: list[str], value: str, members: list[str], cleaned: list[Column] | None = None) -> DataFrame:
    """Rows, distinct members, smallest and mean usable value of every key.

    With `cleaned`, one expression over `keys` for each of them, keys are what these make of the stored
    ones. They are evaluated on the distinct stored keys only, not on the rows.

    Columns: `keys`, `n_rows`, `n_members` (distinct non-null texts of all columns in `members`
    together), `n_usable`, `min_value`, `mean_value`. Usable values are finite and not negative;
    without one, `min_value` and `mean_value` are null. Every stored row counts, repeated ones too;
    a null in a key column is a key of its own. An empty table gives no rows.

    Two scans: the dictionary of keys, then the accumulators. What is shuffled is one array block
    per split and touched block, and one bit row per member and 64 keys.
    """
    clash = {"n_rows", "n_members", "n_usable", "min_value", "mean_value"} & set(keys)
    if clash:
        raise ValueError(f"keys must not be named {sorted(clash)}")
    clean = [F.col(f"`{k}`") for k in keys] if cleaned is None else cleaned
    named, keys = keys, [f"_g{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{k}`").alias(g) for k, g in zip(named, keys)], F.col(f"`{value}`").cast("double").alias("_value"), *[F.col(f"`{m}`").cast("string").alias(f"_m{i}") for i, m in enumerate(members)])
    names = [f"_m{i}" for i in range(len(members))]
    raw = [f"_raw{i}" for i in range(len(keys))]
    distinct = rows.select(*keys).distinct().select(*[F.col(g).alias(k) for g, k in zip(keys, named)])
    stored = written(distinct.select(*[c.alias(g) for c, g in zip(clean, keys)], *[F.col(f"`{k}`").alias(r) for k, r in zip(named, raw)]), "stored-keys")
    dictionary, n_keys = dense_codes(stored.select(*keys))
    spelled = encoded(stored, keys, dictionary, n_keys, raw).select(*[F.col(r).alias(g) for r, g in zip(raw, keys)], "code")
    coded = encoded(rows, keys, spelled, stored.count(), ["_value", *names])

    blocks = coded.select("code", F.col("_value").alias("value")).mapInPandas(
        _value_blocks, "block long, n_rows array<long>, n_usable array<long>, total array<double>, least array<double>"
    )
    cells = blocks.select("block", F.posexplode(F.arrays_zip("n_rows", "n_usable", "total", "least")).alias("at", "c"))
    values = (
        cells.where("c.n_rows > 0")
        .groupBy((F.col("block") * BLOCK + F.col("at")).alias("code"))
        .agg(F.sum("c.n_rows").alias("n_rows"), F.sum("c.n_usable").alias("n_usable"), F.sum("c.total").alias("_total"), F.min("c.least").alias("_least"))
    )

    word = F.floor(F.col("code") / 64)
    bits = (
        coded.select("code", F.explode(F.array(*names)).alias("member"))
        .where("member IS NOT NULL")
        .groupBy("member", word.alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(code % 64))")).alias("bits"))
    )
    present = bits.select("word", "bits").mapInPandas(_member_blocks, "block long, n_members array<long>")
    counts = (
        present.select("block", F.posexplode("n_members").alias("at", "n"))
        .where("n > 0")
        .groupBy((F.col("block") * BLOCK + F.col("at")).alias("code"))
        .agg(F.sum("n").alias("n_members"))
    )
    usable = F.col("n_usable") > 0
    return (
        dictionary.join(values, "code")
        .join(counts, "code", "left")
        .select(
            *[F.col(g).alias(k) for k, g in zip(named, keys)],
            "n_rows",
            F.coalesce("n_members", F.lit(0)).cast("long").alias("n_members"),
            "n_usable",
            F.when(usable, F.col("_least")).alias("min_value"),
            F.when(usable, F.col("_total") / F.col("n_usable")).alias("mean_value"),
        )
    )


def heavy_groups(statistics: DataFrame, total_rows: int | None = None, share: float = 0.05) -> DataFrame:
    """The rows of `dense_group_statistics` whose key holds at least `share` of `total_rows`, by default of the rows of all keys; keys with a null are left out."""
    if total_rows is None:
        statistics = written(statistics, "statistics")
        total_rows = statistics.agg(F.sum("n_rows")).first()[0] or 0
    keys = statistics.columns[: statistics.columns.index("n_rows")]
    return statistics.where(F.col("n_rows") >= F.lit(share) * F.lit(total_rows)).na.drop(subset=keys)
