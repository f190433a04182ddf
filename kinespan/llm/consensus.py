"""One label per item from annotators who disagree: message passing on the item-annotator graph.

For each class against the rest, every label edge carries two messages. To the annotator: how
probable the class is for the item by all its other labels. To the item: what the annotator's label
says for or against the class, by how its labels fit all its other items. They are exchanged until
they stand still. Both leave out the edge they travel on, so nobody confirms themselves.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from kinespan.operators.hot_join import hot_values, unique_join
from kinespan.workspace import discard, written

#: Tables of annotators' labels of at most this many rows are broadcast; larger ones are joined with salted edges.
BROADCAST_HABITS = 50_000
SALTS = 16
#: Labels that a new annotator is supposed to have given as all annotators did on average.
PRIOR = 4.0
#: Classes that are accepted: what is summed up by label and class goes to the driver.
MAX_CLASSES = 30
#: The rounds end when no message to an annotator moves by more.
STILL = 0.005
#: Rounds after which messages go but half of the way, so that they can't swing for ever; rounds after which it is an error that they still move.
DAMPED, MAX_ROUNDS = 20, 200


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _shares(odds: list[Column]) -> list[Column]:
    """Log-odds of the classes, each against the rest, as probabilities that sum to one."""
    top = F.greatest(*odds) if len(odds) > 1 else odds[0]
    return [F.exp(o - top) / _sum([F.exp(x - top) for x in odds]) for o in odds]


def _masses(classes: list[str]) -> list[Column]:
    """Sums of the messages by label and class, to be observed where messages are written."""
    return [F.sum(F.when(F.col("label") == x, F.col(f"m{c}")).otherwise(0.0)).alias(f"m{i}_{c}") for i, x in enumerate(classes) for c in range(len(classes))]


def _habits(edges: DataFrame, classes: list[str], n: list[int], mass: dict[str, float]) -> DataFrame:
    """What annotators do: per annotator and label, sums over their edges by class, and all they are compared with.

    `n`: labels of each kind, `mass`: observed `_masses`. `a{c}`: expected labels on items of class c, `all{c}` the same over all labels, `n` and `n_all` labels;
    `u{c}`, `v{c}`: how often anybody gives this label to the class and to the rest; `q{c}`: the class's log-odds.
    """
    k = range(len(classes))
    own = edges.groupBy("annotator", "label").agg(F.count("*").alias("n"), *[F.sum(f"m{c}").alias(f"a{c}") for c in k])
    whole = Window.partitionBy("annotator")  # as many rows as there are classes
    columns: dict[str, Column] = {"n_all": F.sum("n").over(whole)} | {f"all{c}": F.sum(f"a{c}").over(whole) for c in k}
    total = max(sum(n), 1)
    for c in k:
        to_class = [mass.get(f"m{x}_{c}") or 0.0 for x in k]
        to_rest = [n[x] - to_class[x] for x in k]
        p = min(max(sum(to_class) / total, 1e-4), 1 - 1e-4)
        # one label of each kind beforehand, three where label and class agree
        for name, sizes in ((f"u{c}", [m + (3.0 if x == c else 1.0) for x, m in enumerate(to_class)]), (f"v{c}", [m + 1.0 for m in to_rest])):
            columns[name] = F.element_at(F.create_map(*[F.lit(y) for x in k for y in (classes[x], sizes[x] / sum(sizes))]), F.col("label"))
        columns[f"q{c}"] = F.lit(log(p / (1 - p)))
    return own.withColumns(columns)


def _to_items(edges: DataFrame, classes: list[str], habits: DataFrame, few: bool) -> DataFrame:
    """`edges` with `w{c}`, the annotator's log-odds for class c by its label here, from its other edges, and `q{c}`."""
    k = range(len(classes))
    if few:
        met = edges.join(F.broadcast(habits), ["annotator", "label"])
    else:
        salted = habits.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = edges.withColumn("_s", F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int")).join(salted, ["annotator", "label", "_s"])

    def weight(c: int) -> Column:
        a, whole, m = F.col(f"a{c}"), F.col(f"all{c}"), F.col(f"m{c}")
        for_class = (F.greatest(a - m, F.lit(0.0)) + PRIOR * F.col(f"u{c}")) / (F.greatest(whole - m, F.lit(0.0)) + PRIOR)
        for_rest = (F.greatest(F.col("n") - a - (1 - m), F.lit(0.0)) + PRIOR * F.col(f"v{c}")) / (F.greatest(F.col("n_all") - whole - (1 - m), F.lit(0.0)) + PRIOR)
        return F.log(for_class / for_rest).alias(f"w{c}")

    return met.select("item", "annotator", "label", *[f"m{c}" for c in k], *[f"q{c}" for c in k], *[weight(c) for c in k])


def _scores(weighed: DataFrame, classes: list[str]) -> DataFrame:
    """`item`, `n_labels` and `s{c}`, the log-odds of each class by all labels of the item."""
    k = range(len(classes))
    return weighed.groupBy("item").agg(F.count("*").alias("n_labels"), *[(F.sum(f"w{c}") + F.max(f"q{c}")).alias(f"s{c}") for c in k])


def consensus(labels: DataFrame, item: str, annotator: str, label: str, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Items (`item`, `label`, `confidence`, `agreement`, `n_labels`) and annotators (`annotator`, `reliability`, `n_labels`).

    Labels outside `classes` and rows without item or annotator do not count; a label that an
    annotator repeats on an item counts once, different ones count each. `confidence` is the class's
    share of the odds of all classes, `agreement` the share of the item's pairs of labels that agree
    (null for one label), `reliability` the expected share of the annotator's labels that are right.
    Equal odds go to the class named first. An empty table gives no rows.
    """
    k = range(len(classes))
    if not 1 <= len(classes) <= MAX_CLASSES:
        raise ValueError(f"1 to {MAX_CLASSES} classes")
    edges = labels.select(F.col(item).cast("string").alias("item"), F.col(annotator).cast("string").alias("annotator"), F.col(label).cast("string").alias("label"))
    edges = written(edges.where(F.col("label").isin(classes) & F.col("item").isNotNull() & F.col("annotator").isNotNull()).distinct(), "labels")
    votes = [F.count_if(F.col("label") == c).alias(f"v{x}") for x, c in enumerate(classes)]
    tally = written(edges.groupBy("item").agg(F.count("*").alias("n"), *votes), "votes")
    seen = edges.agg(F.count_distinct("annotator").alias("annotators"), *votes).first()
    n = [seen[f"v{x}"] for x in k]
    few, hot = seen["annotators"] * len(classes) <= BROADCAST_HABITS, hot_values(tally, "item")
    share = [min(max(n[x] / max(sum(n), 1), 1e-3), 1 - 1e-3) for x in k]
    own = [(F.col("label") == c).cast("double") for c in classes]
    start = unique_join(edges, tally, "item", hot, "inner").select(
        "item", "annotator", "label", *[((F.col(f"v{x}") - own[x] + share[x]) / F.col("n")).alias(f"m{x}") for x in k]
    )
    told = Observation()
    state = written(start.observe(told, *_masses(classes)), "messages")
    for nr in range(MAX_ROUNDS):
        weighed = _to_items(state, classes, _habits(state, classes, n, told.get), few)
        fresh = unique_join(weighed, _scores(weighed, classes), "item", hot, "inner")
        other = _shares([F.col(f"s{c}") - F.col(f"w{c}") for c in k])
        if nr >= DAMPED:
            other = [(o + F.col(f"m{c}")) / 2 for c, o in enumerate(other)]
        moved = F.greatest(*[F.abs(other[c] - F.col(f"m{c}")) for c in k]) if len(classes) > 1 else F.abs(other[0] - F.col("m0"))
        fresh = fresh.select("item", "annotator", "label", *[other[c].alias(f"m{c}") for c in k], moved.alias("moved"))
        told = Observation()
        after = written(fresh.observe(told, F.max("moved").alias("far"), *_masses(classes)), "messages")
        far = told.get["far"]
        discard(state)
        state = after
        if far is None or far <= STILL:
            break
    else:
        raise RuntimeError(f"messages still move after {MAX_ROUNDS} rounds")
    scores = _scores(_to_items(state, classes, _habits(state, classes, n, told.get), few), classes)
    p = [x.alias(f"p{c}") for c, x in enumerate(_shares([F.col(f"s{c}") for c in k]))]
    best = F.element_at(F.array(*map(F.lit, classes)), F.array_position(F.array(*[F.col(f"p{c}") for c in k]), F.greatest(*[F.col(f"p{c}") for c in k])).cast("int"))
    agree = _sum([F.col(f"v{x}") * (F.col(f"v{x}") - 1) for x in k])
    chosen = written(scores.select("item", "n_labels", *p), "posterior").join(tally, "item")
    items = chosen.select(
        "item", best.alias("label"), F.greatest(*[F.col(f"p{c}") for c in k]).alias("confidence"),
        F.when(F.col("n") > 1, agree / (F.col("n") * (F.col("n") - 1))).alias("agreement"), "n_labels",
    )
    right = _sum([F.when(F.col("label") == c, F.col(f"p{x}")).otherwise(0.0) for x, c in enumerate(classes)])
    annotators = edges.join(chosen.select("item", *[f"p{c}" for c in k]), "item").groupBy("annotator").agg(
        F.avg(right).alias("reliability"), F.count("*").alias("n_labels")
    )
    return items, annotators


def krippendorff_alpha(labels: DataFrame, item: str, annotator: str, label: str) -> DataFrame:
    """One row: `n_items`, `n_labels` and `alpha` (nominal) of all items with at least two labels; `alpha` is null without two classes."""
    seen = labels.select(F.col(item).alias("i"), F.col(annotator).alias("a"), F.col(label).alias("l")).na.drop().distinct()
    cells = seen.groupBy("i", "l").agg(F.count("*").alias("n"))
    items = cells.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q")).where("n > 1")
    observed = items.agg(F.count("*").alias("n_items"), F.sum("n").alias("n_labels"), F.sum((F.col("n") * F.col("n") - F.col("q")) / (F.col("n") - 1)).alias("d"))
    classes = cells.join(items.select("i"), "i", "left_semi").groupBy("l").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("q"))
    both = observed.withColumn("_one", F.lit(1)).join(F.broadcast(classes.withColumn("_one", F.lit(1))), "_one")
    expected = (F.col("n_labels") * F.col("n_labels") - F.col("q")) / (F.col("n_labels") - 1)
    return both.select("n_items", F.coalesce("n_labels", F.lit(0)).cast("long").alias("n_labels"), F.when(expected > 0, 1 - F.col("d") / expected).alias("alpha"))
