"""Mixing sources to target weights, to the token.

A source's budget is its share of the target weights times the mixture's size. Whole passes over the
source come first, as many as the budget and the cap on repeats allow. What is left is a subset-sum
problem: documents are counted by their exact length, an even share of all lengths is set aside as far
as that leaves the fitting enough room, and a bounded-knapsack dynamic programme over counts by length
meets the rest, giving back of the even share what it needs. Only counts by length enter it; the
documents themselves are then drawn by a seeded hash, as many of each length as were settled.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespan.workspace import written

#: Tokens over which the dynamic programme runs at first, and at most; in between it takes eight times as many each time.
WINDOW, WIDEST = 1 << 16, 1 << 25
#: Hash ranges in which the documents of one source and length are counted; only one of them is ranked.
RANGES = 256
#: Counts by source and length of at most so many rows are broadcast; more are joined.
BROADCAST_LENGTHS = 200_000


def source_key(c: Column) -> Column:
    """A source's letters in lower case, which alone distinguish sources; null for a text without letters."""
    letters = F.regexp_replace(F.lower(c), r"[^\p{L}]", "")
    return F.when(letters != "", letters)


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, at most `counts`, so that the sum comes nearest below `budget`. Sorted `lengths` over 0.

    The sum is the best there is where it meets the budget, and wherever the budget is at most WIDEST
    tokens (counted in their common divisor), since the programme then runs over all of it. For a larger budget that no
    choice within the widest window meets, the sum falls short by less than the shortest document
    that is not taken. Windows only bound how much of the even share can be given back.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    whole = int((lengths * counts).sum())
    if budget >= whole or not len(lengths):
        return counts.copy()
    if budget <= 0:
        return np.zeros(len(lengths), np.int64)
    unit = reduce(gcd, lengths.tolist())
    lengths, whole, budget = lengths // unit, whole // unit, budget // unit
    best, reached, window = np.zeros(len(lengths), np.int64), -1, max(WINDOW, 4 * int(lengths[-1]))
    while True:
        base = _even(lengths, counts, max(0, budget - min(window, WIDEST)), whole)
        rest = budget - int((lengths * base).sum())
        take = base + _nearest(lengths, counts - base, rest)
        if int((lengths * take).sum()) > reached:
            best, reached = take, int((lengths * take).sum())
        if reached == budget or not base.any() or window >= WIDEST:
            return best
        window *= 8


def _even(lengths: np.ndarray, counts: np.ndarray, amount: int, whole: int) -> np.ndarray:
    """Of each length about the same share, `amount` of `whole` tokens in all, less at most the longest document: what a length leaves over goes to the next."""
    take, carry = np.zeros(len(lengths), np.int64), 0.0
    for i, (n, c) in enumerate(zip(lengths.tolist(), counts.tolist())):
        wish = carry + n * c * (amount / whole)
        take[i] = min(c, int(wish / n))
        carry = wish - take[i] * n
    return take


def _nearest(lengths: np.ndarray, counts: np.ndarray, rest: int) -> np.ndarray:
    """How many of each length sum up nearest below `rest`, by dynamic programming."""
    take, items = np.zeros(len(lengths), np.int64), []
    for i in range(len(lengths)):
        # powers of two make each count's choices few
        left, size = int(min(counts[i], rest // int(lengths[i]))), 1
        while left > 0:
            items.append((i, min(size, left)))
            left -= size
            size *= 2
    # bit t is set if some documents sum to t; `via` is the item that reached t first, so the way back has each item once
    mask, reach, via = (1 << (rest + 1)) - 1, 1, np.full(rest + 1, -1, np.int32)
    for nr, (i, n) in enumerate(items):
        fresh = (reach << (n * int(lengths[i]))) & mask & ~reach
        if fresh:
            bits = np.frombuffer(fresh.to_bytes(rest // 8 + 1, "little"), np.uint8)
            some = np.flatnonzero(bits)
            at = np.flatnonzero(np.unpackbits(bits[some], bitorder="little"))
            via[some[at >> 3] * 8 + (at & 7)] = nr
            reach |= fresh
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    while at:
        i, n = items[via[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def _settle(histogram: pd.DataFrame) -> pd.DataFrame:
    """Of one source's counts by length: whole passes over it and further documents of each length."""
    rows = histogram.sort_values("n_tokens", ignore_index=True)
    cap, budget = int(rows["max_repeats"][0]), int(rows["budget"][0])
    lengths, counts = rows["n_tokens"].to_numpy(np.int64), rows["n_docs"].to_numpy(np.int64)
    whole = int((lengths * counts).sum())
    passes = min(cap, budget // whole) if whole else 0
    used = lengths > 0
    extra = np.zeros(len(lengths), np.int64)
    if passes < cap:
        extra[used] = fit(lengths[used], counts[used], budget - passes * whole)
    return pd.DataFrame({"source": rows["source"], "n_tokens": lengths, "passes": passes, "extra": extra})


def budgets(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """`source`, `max_repeats`, `share`, `wish` (tokens), `budget` (whole tokens), `available` for each row of `targets`.

    `targets`: `source`, `target_weight`, `max_repeats`; null weights count as 0, null or negative
    caps as 0. `total`: the mixture's size in tokens; by default that of all listed sources.
    """
    wanted = targets.select(
        F.col("source").alias("listed"), source_key(F.col("source")).alias("source"),
        F.greatest(F.coalesce(F.col("target_weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"),
        F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)), F.lit(0)).alias("max_repeats"),
    ).where("source IS NOT NULL")
    held = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    met = wanted.join(held, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("long"))
    met = written(met, "sources")
    sums = met.agg(F.sum("weight").alias("w"), F.sum("available").alias("t")).first()
    size, weights = total if total is not None else (sums["t"] or 0), sums["w"] or 0.0
    share = F.col("weight") / F.lit(weights) if weights else F.lit(0.0)
    wish = share * F.lit(size)
    return met.withColumn("share", share).withColumn("wish", wish).withColumn("budget", F.floor("wish").cast("long"))


def sized_documents(documents: DataFrame, targets: DataFrame, tokens: str = "n_tokens") -> DataFrame:
    """`doc_id`, `source` (as `source_key`) and `n_tokens` of the documents of listed sources."""
    listed = [r[0] for r in targets.select(source_key(F.col("source"))).distinct().limit(10_001).collect() if r[0]]
    if len(listed) > 10_000:
        raise ValueError("more than 10000 sources")
    return documents.select("doc_id", source_key(F.col("source")).alias("source"), F.col(tokens).cast("long").alias("n_tokens")).where(F.col("source").isin(listed))


def draw(sized: DataFrame, budget: DataFrame, seed: int = 20260715) -> DataFrame:
    """`doc_id`, `source`, `n_tokens`, `copies` of the drawn documents: every one at most `max_repeats` times.

    `sized` (`doc_id`, `source`, `n_tokens`) should be a written table. Documents without tokens are
    never drawn beyond whole passes. Same input and seed, same draw. The counts of one source by
    length go to one task; there are at most as many as the longest document has tokens. Documents
    are counted in ranges of their hash; those of ranges below or above the last drawn one are taken or left where
    they are, and only that range's, one in RANGES, are ranked.
    """
    histogram = sized.groupBy("source", "n_tokens").agg(F.count("*").alias("n_docs"))
    plan = histogram.join(F.broadcast(budget.select("source", "max_repeats", "budget")), "source")
    plan = written(plan.groupBy("source").applyInPandas(_settle, "source string, n_tokens long, passes int, extra long"), "plan")
    placed = sized.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    # ranges in the order of the hash, so that ranking within a range goes on from the ranges before it
    placed = placed.withColumn("_range", F.shiftrightunsigned("_h", 64 - RANGES.bit_length() + 1).cast("int"))
    sizes = placed.groupBy("source", "n_tokens", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source", "n_tokens").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    last = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(plan.where("extra > 0"), ["source", "n_tokens"])
    last = last.where("_before < extra AND extra <= _before + _n").select("source", "n_tokens", F.col("_range").alias("_last"), (F.col("extra") - F.col("_before")).alias("_within"))
    plan = written(plan.join(last, ["source", "n_tokens"], "left"), "plan")
    few = plan.count() <= BROADCAST_LENGTHS
    met = placed.join(F.broadcast(plan) if few else plan, ["source", "n_tokens"])
    edge = F.coalesce(F.col("_range") == F.col("_last"), F.lit(False))
    apart = met.where(~edge).withColumn("copies", F.col("passes") + F.coalesce(F.col("_range") < F.col("_last"), F.lit(False)).cast("int"))
    within = Window.partitionBy("source", "n_tokens", "_range").orderBy("_h", "doc_id")
    ranked = met.where(edge).withColumn("copies", F.col("passes") + (F.row_number().over(within) <= F.col("_within")).cast("int"))
    return apart.unionByName(ranked).select("doc_id", "source", "n_tokens", "copies").where("copies > 0")


def reached_shares(drawn: DataFrame, budget: DataFrame) -> DataFrame:
    """`source` as listed, `target_share`, `reached_share`, `budget`, `n_tokens`, `n_documents`, `n_copies`: what was really reached.

    `exhausted`: all of the source's tokens were drawn as often as allowed; `short`: they are, and fall short of the share wished for.
    """
    got = drawn.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.count("*").alias("n_documents"), F.sum("copies").alias("n_copies")
    )
    met = written(budget.join(got, "source", "left").na.fill(0, ["n_tokens", "n_documents", "n_copies"]), "reached")
    total = met.agg(F.sum("n_tokens")).first()[0] or 0
    reached = F.col("n_tokens") / F.lit(total) if total else F.lit(None).cast("double")
    exhausted = F.col("n_tokens") == F.col("max_repeats") * F.col("available")
    return met.select(
        F.col("listed").alias("source"), F.col("share").alias("target_share"), reached.alias("reached_share"), "budget", "n_tokens", "n_documents", "n_copies",
        exhausted.alias("exhausted"), (exhausted & (F.col("n_tokens") < F.col("wish"))).alias("short"),
    )
