"""The resampling study with a matrix in a task: all repetitions of a size and a number of templates are solved at once.

Spark deals the matrices out; a task reads the stored distances of one as they come, packs them, and works on
arrays whose first axis is the repetition. Every matrix of a study is solved in this way, whatever its size: of a
large one the arrays are in files instead of memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, permutations
from tempfile import TemporaryFile
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespan.operators.resampling import GRID, HELD_OUT, REPETITIONS, SEED
from kinespan.operators.study import QUANTILES
from kinespan.operators.templates import RELATIVE, SUPPORT_LEAST, SUPPORT_SHARE, TOLERANCE, random_templates
from kinespan.workspace import spread, written

#: Clips of a matrix that `solved_templates` gets whole at most; the long table gives the same for larger ones.
MOST_CLIPS = 2_000
#: Bytes of an array, or of pairs, that are in memory at most; larger ones are in files.
MOST_BYTES = 256_000_000
#: Numbers of an array that is worked on at a time, about: as many as stay in a core's cache.
CELLS = 64_000
#: Numbers of an array that is held for many trials at once, about.
MOST_CELLS = 500_000
#: Share of the between scale up to which a child's choice of template counts as ambiguous.
AMBIGUOUS = 0.05


#: A pair of clips by their places, as it is held until all of a matrix's pairs have come.
_PAIR = np.dtype([("i", "i4"), ("j", "i4"), ("d", "f8")])


def _array(shape: tuple[int, int]) -> np.ndarray:
    """Room for numbers; of more than MOST_BYTES in a file that goes with the array."""
    if 8 * shape[0] * shape[1] <= MOST_BYTES:
        return np.empty(shape)
    with TemporaryFile() as file:
        return np.asarray(np.memmap(file, np.float64, "w+", shape=shape))


class _Pairs:
    """Pairs in the order they come; of more than MOST_BYTES those that came first are in a file."""

    def __init__(self):
        self.held, self.file = [], None

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        more = np.empty(len(d), _PAIR)
        more["i"], more["j"], more["d"] = i, j, d
        self.held.append(more)
        if sum(x.nbytes for x in self.held) > MOST_BYTES:
            self.file = self.file or TemporaryFile()
            np.concatenate(self.held).tofile(self.file)
            self.held = []

    def __iter__(self) -> Iterator[np.ndarray]:
        if self.file:
            self.file.seek(0)
            while len(x := np.fromfile(self.file, _PAIR, 1_000_000)):
                yield x
        yield from self.held


class Matrix:
    """The distances of one matrix: clips in order of their ids, children in order of theirs, and the children's costs.

    An unknown distance counts as the child's mean known one to that clip, and where it has none as its greatest cost.
    Made of `templates.clip_distances`, or by `streamed` of the rows of `matrix_rows`; arrays that don't fit in memory are in files.
    """

    def __init__(self, rows: pd.DataFrame):
        clips = rows.drop_duplicates("segment_id").sort_values("segment_id")
        at = {s: i for i, s in enumerate(clips["segment_id"])}
        self._fill(list(at), clips["child"].tolist(), [(rows["segment_id"].map(at), rows["candidate"].map(at), rows["distance"])])

    @classmethod
    def streamed(cls, batches: Iterable[pd.DataFrame]) -> Matrix:
        """Of `matrix_rows` of one matrix, in any order."""
        code, child, pairs = {}, {}, _Pairs()
        for rows in batches:
            named = rows["distance"].isna().to_numpy()
            a, b = rows["a"].to_numpy(object), rows["b"].to_numpy(object)
            child.update(zip(a[named], b[named]))
            at, ids = pd.factorize(np.concatenate([a[~named], b[~named]]))
            at = np.array([code.setdefault(x, len(code)) for x in ids], np.int32)[at]
            pairs.add(*at.reshape(2, -1), rows["distance"].to_numpy()[~named])
        ids = sorted(child)
        place = np.empty(len(ids), np.int32)
        at = {s: i for i, s in enumerate(ids)}
        for s, i in code.items():
            place[i] = at[s]

        def entries() -> Iterator[tuple]:
            own = np.arange(len(ids))
            yield own, own, 0.0
            for x in pairs:
                i, j = place[x["i"]], place[x["j"]]
                yield i, j, x["d"]
                yield j, i, x["d"]

        m = cls.__new__(cls)
        m._fill(ids, [child[s] for s in ids], entries())
        return m

    def _fill(self, ids: list[str], child: list[str], entries: Iterable[tuple]) -> None:
        self.ids, self.children = ids, sorted(set(child))
        of, n = {c: i for i, c in enumerate(self.children)}, len(ids)
        self.origin = np.array([of[c] for c in child])
        self.by_child, self.n_own = np.argsort(self.origin, kind="stable"), np.bincount(self.origin)
        self.first = np.cumsum(self.n_own) - self.n_own
        self.known, self.cost = _array((n, n)), _array((len(self.children), n))
        self.known[:] = np.nan
        for i, j, d in entries:
            self.known[i, j] = d
        step, per, same = max(1, MOST_CELLS // (n * int(self.n_own.max()))), [], []
        for at in range(0, len(self.children), step):
            own = np.arange(at, min(at + step, len(self.children)))
            i = self.by_child[self.first[own[0]] : self.first[own[-1]] + self.n_own[own[-1]]]
            self.cost[own], found = self._costs(self.known[i], self.first[own] - self.first[at]), self._medians(i)
            per.append(found[0])
            same.append(found[1])
        per, same = np.concatenate(per), np.concatenate(same)
        median = lambda x: float(np.median(x)) if len(x) else float("nan")
        self.between, self.within = median(per[~same]), median(per[same])

    def _costs(self, known: np.ndarray, first: np.ndarray) -> np.ndarray:
        seen = np.isfinite(known)
        count, total = np.add.reduceat(seen.astype(float), first), np.add.reduceat(np.where(seen, known, 0.0), first)
        cost = np.where(count > 0, total / np.maximum(count, 1), np.nan)
        return np.where(np.isfinite(cost), cost, np.nanmax(cost, axis=1, keepdims=True))

    def _medians(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs of these clips' children with them and later ones: the clips' median known distance, and whether a pair is one child."""
        known, mine = self.known[rows], self.origin[rows][:, None]
        i, j = np.nonzero(np.isfinite(known) & ((mine < self.origin) | ((mine == self.origin) & (rows[:, None] < np.arange(len(self.ids))))))
        a, b, d = self.origin[rows[i]], self.origin[j], known[i, j]
        order = np.lexsort((d, b, a))
        a, b, d = a[order], b[order], d[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(d)])
        n = np.diff(np.r_[first, len(d)])
        return (d[first + (n - 1) // 2] + d[first + n // 2]) / 2, a[first] == b[first]

    def filled(self, sets: np.ndarray) -> np.ndarray:
        """The distance of every clip to those of `sets` [clip, ...], known or not."""
        known = self.known[:, sets]
        return np.where(np.isfinite(known), known, self.cost[:, sets][self.origin])

    def of_children(self, x: np.ndarray) -> np.ndarray:
        """The mean over each child's clips of `x` [trial, clip]."""
        return np.add.reduceat(x[:, self.by_child], self.first, axis=1) / self.n_own

    @property
    def near(self) -> float:
        """Up to where two templates count as alike."""
        return self.within if self.within > 0 else 0.1 * self.between


def solved(m: Matrix, train: np.ndarray, k: int, starts: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Objectives [trial] and sorted templates [trial, slot]: the best of a greedy and `starts` - 1 random starts, each refined by swaps.

    `train` [trial, child]: who belongs to a trial; candidates are these children's clips. Objectives are
    compared at 9 decimals; ties go to the templates that come first.
    """
    return _best(m, train, [_greedy(m, train, k), *_random(m, train, k, starts, rng)])


def _random(m: Matrix, train: np.ndarray, k: int, starts: int, rng: np.random.Generator) -> list[np.ndarray]:
    """`starts` - 1 random sets [trial, slot]: `k` different children of each trial and a clip of each."""
    found = []
    for _ in range(starts - 1):
        by_child, by_clip = rng.random(train.shape), rng.random((len(train), len(m.ids)))
        chosen = np.argsort(np.where(train, by_child, 2.0), axis=1, kind="stable")[:, :k]
        own = m.origin[None, None, :] == chosen[:, :, None]
        found.append(np.where(own, by_clip[:, None, :], 2.0).argmin(axis=2))
    return found


def _best(m: Matrix, train: np.ndarray, begun: list[np.ndarray], by_ids: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Objectives and sets of the best of several sets [trial, slot] of every trial, all refined at once."""
    step = max(1, MOST_CELLS // (len(begun) * begun[0].shape[1] * len(m.ids)))
    if len(train) > step:
        parts = [_best(m, train[at : at + step], [x[at : at + step] for x in begun], by_ids) for at in range(0, len(train), step)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    t = np.arange(len(train))
    sets, values = _refined(m, train, np.tile(t, len(begun)), np.concatenate(begun), by_ids)
    sets, values = sets.reshape(len(begun), len(train), -1), values.reshape(len(begun), -1)
    best, value = sets[0], values[0]
    for other, worth in zip(sets[1:], values[1:]):
        a, b = np.round(worth, 9), np.round(value, 9)
        first = (best != other).argmax(axis=1)
        better = (a < b) | ((a == b) & (other[t, first] < best[t, first]))
        best, value = np.where(better[:, None], other, best), np.where(better, worth, value)
    return value, best


def _sums(m: Matrix, running: np.ndarray) -> np.ndarray:
    """The sum over the children of the lesser of `running` [child, row] and the cost of each candidate [clip, row]; children in their order."""
    out = np.empty((len(m.ids), running.shape[1]))
    step = max(1, CELLS // len(m.ids))
    for at in range(0, running.shape[1], step):
        part = running[:, at : at + step]
        total = np.zeros((len(m.ids), part.shape[1]))
        held = np.empty_like(total)
        for least, cost in zip(part, m.cost):
            total += np.minimum(least, cost[:, None], out=held)
        out[:, at : at + step] = total
    return out


def _greedy(m: Matrix, train: np.ndarray, k: int) -> np.ndarray:
    t, running = np.arange(len(train)), np.full(train.shape, np.inf)
    open_, picks = train[:, m.origin].copy(), []
    size = train.sum(axis=1)[:, None]
    for _ in range(k):
        value = np.where(open_, np.round(_sums(m, np.where(train, running, 0.0).T).T / size, 9), np.inf)
        pick = value.argmin(axis=1)
        picks.append(pick)
        running = np.minimum(running, m.cost[:, pick].T)
        open_ &= m.origin[None, :] != m.origin[pick][t, None]
    return np.stack(picks, axis=1)


def _refined(m: Matrix, train: np.ndarray, of: np.ndarray, sets: np.ndarray, by_ids: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """`sets` [set, slot] of the trials `of`, sorted, after the swaps of one template that lower each objective most, until none does, and the objectives.

    Of swaps that are worth the same the first slot's first clip is taken, or with `by_ids` that whose set comes first.
    A set that comes to where one of the same trial has been ends where that one ends, so it is not followed.
    """
    sets = np.sort(sets, axis=1)
    k, n = sets.shape[1], len(m.ids)
    going, follows = np.arange(len(sets)), np.arange(len(sets))
    value = _objectives(m, train[of], sets)
    codes, who = np.empty(0, np.int64), np.empty(0, np.int64)
    while len(going):
        if len(train) * n**k < 2**62:
            code = of[going]
            for s in range(k):
                code = code * n + sets[going, s]
            codes, who = np.concatenate([codes, code]), np.concatenate([who, going])
            codes, first = np.unique(codes, return_index=True)
            owner = who[first][np.searchsorted(codes, code)]
            who = who[first]
            follows[going] = owner
            going = going[owner == going]
            if not len(going):
                break
        own, mine, g = sets[going], train[of[going]].T, np.arange(len(going))
        running = _without_each(m, mine, own)  # [child, slot, set]
        proposals = _sums(m, running.reshape(len(mine), -1)).reshape(n, k, len(g))
        proposals /= mine.sum(axis=0)
        np.round(proposals, 9, out=proposals)
        same = m.origin[:, None, None] == m.origin[own].T
        free = mine[m.origin] & ~same.any(axis=1)
        for s in range(k):
            np.copyto(proposals[:, s], np.inf, where=~(free | same[:, s] & mine[m.origin]))
            proposals[own[:, s], s, g] = np.inf
        clip = proposals.argmin(axis=0)
        worth = np.take_along_axis(proposals, clip[None], axis=0)[0]
        slot = worth.argmin(axis=0)
        for i in g if by_ids else ():
            c, s = np.nonzero(proposals[:, :, i] == worth[slot[i], i])
            x = min(range(len(c)), key=lambda x: np.sort(np.where(np.arange(k) == s[x], c[x], own[i])).tolist())
            slot[i], clip[s[x], i] = s[x], c[x]
        own[g, slot] = clip[slot, g]
        fresh = _objectives(m, mine.T, own)
        # equal objectives may round differently, so what counts is the new set's own
        lower = np.isfinite(worth[slot, g]) & (fresh < value[going] - np.maximum(TOLERANCE, RELATIVE * value[going]))
        going = going[lower]
        sets[going], value[going] = np.sort(own[lower], axis=1), fresh[lower]
    while (follows[follows] != follows).any():
        follows = follows[follows]
    return sets[follows], value[follows]


def _without_each(m: Matrix, members: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """The cost of each child's nearest template when a slot's is taken out [child, slot, set]; 0 for those who are no `members` [child, set]."""
    least, near, next_ = m.cost[:, sets[:, 0]], np.zeros(members.shape, np.int8), np.full(members.shape, np.inf)
    for s in range(1, sets.shape[1]):
        cost = m.cost[:, sets[:, s]]
        closer = cost < least
        next_ = np.where(closer, least, np.minimum(next_, cost))
        near[closer] = s
        least = np.minimum(least, cost)
    least, next_ = np.where(members, least, 0.0), np.where(members, next_, 0.0)
    return np.stack([np.where(near == s, next_, least) for s in range(sets.shape[1])], axis=1)


def _objectives(m: Matrix, train: np.ndarray, sets: np.ndarray) -> np.ndarray:
    least = m.cost[:, sets[:, 0]]
    for s in range(1, sets.shape[1]):
        np.minimum(least, m.cost[:, sets[:, s]], out=least)
    return np.where(train, least.T, 0.0).sum(axis=1) / train.sum(axis=1)


def evaluated(m: Matrix, members: np.ndarray, sets: np.ndarray, ambiguous: float) -> dict[str, np.ndarray]:
    """How the children `members` [trial, n] (positions) do with the templates `sets` [trial, k]: losses, margins, assignments."""
    t, k = np.arange(len(sets))[:, None], sets.shape[1]
    cost = m.cost[:, sets].transpose(1, 0, 2)[t, members]  # [trial, member, slot]
    slot = cost.argmin(axis=2)
    loss = cost.min(axis=2)
    clip = m.filled(sets).transpose(1, 0, 2)  # [trial, clip, slot]
    clip_loss = m.of_children(clip.min(axis=2))[t, members]
    out = {
        "slot": slot, "mean": loss.mean(axis=1), "median": np.median(loss, axis=1), "p90": np.quantile(loss, 0.9, axis=1), "clip_mean": clip_loss.mean(axis=1),
        "margin": np.full(len(sets), np.nan), "ambiguous": np.zeros(len(sets)), "consistency": np.ones(len(sets)),
    }
    if k > 1:
        margins = np.diff(np.sort(cost, axis=2)[:, :, :2], axis=2)[:, :, 0]
        by_child = np.zeros((len(sets), len(m.children)), np.int64)
        by_child[t, members] = slot
        agrees = m.of_children((clip.argmin(axis=2) == by_child[:, m.origin]) * 1.0)
        out |= {"margin": np.median(margins, axis=1), "ambiguous": (margins <= ambiguous).mean(axis=1), "consistency": agrees[t, members].mean(axis=1)}
    return out


def geometry(m: Matrix, left: np.ndarray, right: np.ndarray) -> dict[str, np.ndarray]:
    """How far sets [trial, k] lie apart: the best one-to-one match, its mapping, and nearest ones; NaN where a distance is unknown."""
    k = left.shape[1]
    d = m.known[left[:, :, None], right[:, None, :]]
    orders = np.array(list(permutations(range(k))))
    matched = d[:, np.arange(k)[None, :], orders]  # [trial, order, slot]
    best = np.where(np.isnan(matched).any(axis=2), np.inf, np.round(matched.sum(axis=2), 12)).argmin(axis=1)
    chosen = matched[np.arange(len(left)), best]
    rows, columns = d.min(axis=2), d.min(axis=1)
    bad = np.isnan(d).any(axis=(1, 2))
    found = {
        "match_mean": chosen.mean(axis=1), "match_max": chosen.max(axis=1), "match_p90": np.quantile(chosen, 0.9, axis=1),
        "hausdorff": np.maximum(rows.max(axis=1), columns.max(axis=1)), "nearest_mean": (rows.mean(axis=1) + columns.mean(axis=1)) / 2,
    }
    near = np.where(np.isfinite(d), d, m.cost[m.origin[left][:, :, None], right[:, None, :]]) <= m.near
    covered = (near.any(axis=2).mean(axis=1) + near.any(axis=1).mean(axis=1)) / 2
    return {n: np.where(bad, np.nan, v) for n, v in found.items()} | {"mapping": orders[best], "bad": bad, "near_overlap": covered}


def agreement(left: np.ndarray, right: np.ndarray, mapping: np.ndarray, k: int, among: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Of assignments [trial, member] under both sets: share that agrees after the mapping, adjusted Rand index, Jaccard indexes of the clusters. `among`: which members count."""
    mapped = mapping[np.arange(len(left))[:, None], left]
    among = np.ones(left.shape, bool) if among is None else among
    n = among.sum(axis=1)
    one, other = (mapped[:, :, None] == np.arange(k)) & among[:, :, None], (right[:, :, None] == np.arange(k)) & among[:, :, None]
    cells = np.einsum("tma,tmb->tab", one.astype(float), other.astype(float))
    pairs = lambda x: x * (x - 1) / 2
    c, a, b = pairs(cells).sum(axis=(1, 2)), pairs(cells.sum(axis=2)).sum(axis=1), pairs(cells.sum(axis=1)).sum(axis=1)
    expected = np.where(n > 1, a * b / np.where(n > 1, pairs(n), 1), 0.0)
    room = (a + b) / 2 - expected
    both, either = (one & other).sum(axis=1), (one | other).sum(axis=1)
    jaccard = np.where(either > 0, both / np.maximum(either, 1), 1.0)
    return {
        "agreement": ((mapped == right) & among).sum(axis=1) / n, "ari": np.where(np.abs(room) < 1e-12, 1.0, (c - expected) / np.where(np.abs(room) < 1e-12, 1.0, room)),
        "cluster_jaccard_mean": jaccard.mean(axis=1), "cluster_jaccard_min": jaccard.min(axis=1),
    }


def _jaccard(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    shared = (left[:, :, None] == right[:, None, :]).any(axis=2).sum(axis=1)
    return shared / (2 * left.shape[1] - shared)


def schemes(n: int, held_out: int = HELD_OUT) -> list[tuple[str, int]]:
    """Schemes for a group of `n` children with how many each holds out."""
    second = max(5, int(np.ceil(round(n * 0.2, 9))))
    return ([("primary_h3", held_out)] if n > held_out else []) + ([("secondary_h20", second)] if n - second >= 8 else [])


def orders(m: Matrix, name: str, scheme: str, repetitions: int, seed: int) -> np.ndarray:
    """A permutation of the children for each repetition [repetition, child]: those held out first."""
    return np.argsort(np.random.default_rng([seed, crc32(name.encode()), crc32(scheme.encode())]).random((repetitions, len(m.children))), axis=1, kind="stable")


_NUMBERS = [
    "between", "within", "train_loss", "train_loss_median", "train_loss_p90", "train_clip_loss", "holdout_loss", "holdout_loss_median", "holdout_p90", "holdout_clip_loss", "consistency", "margin",
    "ambiguous", "largest_loss", "excess", "excess_normalized", "jaccard", "near_overlap", "match_mean", "match_max", "match_p90", "match_mean_between", "match_mean_within", "hausdorff_between",
    "nearest_mean_between", "agreement", "ari", "cluster_jaccard_mean", "cluster_jaccard_min", "partner_match_mean", "partner_match_mean_between", "partner_hausdorff_between",
    "partner_nearest_between", "partner_agreement", "partner_ari", "partner_cluster_jaccard",
]
#: What a trial's row has after the keys.
TRIAL = (
    "scheme string, holdout_size int, repetition int, n_children int, maximum int, k int, n_group_children int, n_group_clips int, ids array<string>, template_children array<string>, "
    "assigned array<int>, support_minimum int, support_ok boolean, exact_match boolean, partner_repetition int, " + ", ".join(f"{n} double" for n in _NUMBERS)
)


def _over(value: np.ndarray, scale: float) -> np.ndarray:
    return value / scale if np.isfinite(scale) and scale > 0 else np.full(len(value), np.nan)


def _support(slot: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    counts = (slot[:, :, None] == np.arange(k)).sum(axis=1)
    return counts, max(SUPPORT_LEAST, int(np.ceil(round(slot.shape[1] * SUPPORT_SHARE, 9))))


def _ranked(value: np.ndarray, among: np.ndarray, share: float) -> np.ndarray:
    """The quantile of each row's numbers `among` it, between neighbours in proportion."""
    ordered = np.sort(np.where(among, value, np.inf), axis=1)
    at = (among.sum(axis=1) - 1) * share
    low, t = np.floor(at).astype(int), np.arange(len(value))
    a, b = ordered[t, low], ordered[t, np.ceil(at).astype(int)]
    return a + (b - a) * (at - low)


def _plan(m: Matrix, name: str, chosen: list[tuple[str, int]], grid: list[int], repetitions: int, seed: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Every size and repetition of the `chosen` schemes of a matrix, and who belongs to it and who is held out [trial, child]. Sizes fall within a scheme."""
    rows, train, held = [], [], []
    for scheme, held_out in chosen:
        order, maximum = orders(m, name, scheme, repetitions, seed), len(m.children) - held_out
        outside = np.zeros(order.shape, bool)
        np.put_along_axis(outside, order[:, :held_out], True, axis=1)
        for n in sorted({g for g in grid if 3 <= g <= maximum} | {maximum}, reverse=True):
            inside = np.zeros(order.shape, bool)
            np.put_along_axis(inside, order[:, held_out : held_out + n], True, axis=1)
            rows.append((scheme, held_out, n, maximum))
            train.append(inside)
            held.append(outside)
    columns = {c: np.repeat(np.array(x, object if c == "scheme" else int), repetitions) for c, x in zip(("scheme", "holdout_size", "n_children", "maximum"), zip(*rows))}
    return columns | {"repetition": np.tile(np.arange(1, repetitions + 1), len(rows))}, np.concatenate(train), np.concatenate(held)


def matrix_trials(m: Matrix, name: str, ks: list[int], grid: list[int], repetitions: int, starts: int, seed: int, only: str | None = None) -> Iterator[pd.DataFrame]:
    """All trials of one matrix, or those of `only` one scheme: schemes, repetitions, sizes and numbers of templates, with how each compares to the largest size and to the next repetition.

    All trials of a number of templates are solved and measured at once, those of a large matrix by scheme.
    """
    for solutions in _by_schemes(m, name, ks, grid, repetitions, starts, seed, only):
        found = [_measured(m, plan, train, held, value, sets, repetitions) for _, plan, train, held, value, sets in solutions]
        if found:
            yield pd.DataFrame({c: [y for x in found for y in x[c]] if isinstance(found[0][c], list) else np.concatenate([x[c] for x in found]) for c in found[0]})


def _by_schemes(m: Matrix, name: str, ks: list[int], grid: list[int], repetitions: int, starts: int, seed: int, only: str | None) -> Iterator[Iterator[tuple]]:
    """`_solutions` of all schemes, or of a large matrix those of one after the other."""
    chosen = [x for x in schemes(len(m.children)) if only in (None, x[0])]
    if not chosen or not ks:
        return
    apart = len(chosen) > 1 and repetitions * len(grid) * len(m.ids) * max(ks) > MOST_CELLS
    for some in [[x] for x in chosen] if apart else [chosen]:
        yield _solutions(m, name, some, ks, grid, repetitions, starts, seed)


def _solutions(m: Matrix, name: str, chosen: list[tuple[str, int]], ks: list[int], grid: list[int], repetitions: int, starts: int, seed: int) -> Iterator[tuple]:
    """The number of templates, plan, members, those held out, objectives and sets of all trials of every number that the sizes allow."""
    plan, train, held = _plan(m, name, chosen, grid, repetitions, seed)
    greedy = _greedy(m, train, max(ks))
    for k in ks:
        use = np.flatnonzero(plan["n_children"] >= k)
        if not len(use):
            continue
        begun = []
        for at in range(0, len(use), repetitions):
            i = use[at]
            rng = np.random.default_rng([seed, crc32(name.encode()), crc32(plan["scheme"][i].encode()), int(plan["n_children"][i]), k])
            begun.append(_random(m, train[i : i + repetitions], k, starts, rng))
        value, sets = _best(m, train[use], [greedy[use, :k], *(np.concatenate(x) for x in zip(*begun))])
        yield k, {c: x[use] for c, x in plan.items()}, train[use], held[use], value, sets


def _measured(m: Matrix, plan: dict[str, np.ndarray], train: np.ndarray, held: np.ndarray, value: np.ndarray, sets: np.ndarray, repetitions: int) -> dict[str, np.ndarray | list]:
    """The columns of TRIAL for the trials of a number of templates; `repetitions` rows follow each other for every scheme and size, the largest size first."""
    ids, children, (trials, k) = np.array(m.ids, object), np.array(m.children, object), sets.shape
    block = np.arange(trials) // repetitions * repetitions
    starts_scheme = np.flatnonzero(np.r_[True, plan["scheme"][1:] != plan["scheme"][:-1]])
    top = starts_scheme[np.searchsorted(starts_scheme, block, "right") - 1] + np.arange(trials) - block  # the same repetition's largest size
    cost, clip = m.cost[:, sets].transpose(1, 0, 2), m.filled(sets).transpose(1, 0, 2)
    slot, loss, clip_loss = cost.argmin(axis=2), cost.min(axis=2), m.of_children(clip.min(axis=2))
    size, outside = plan["n_children"], held.sum(axis=1)
    mean = lambda x, among, n: np.where(among, x, 0.0).sum(axis=1) / n
    margin, ambiguous, consistency = np.full(trials, np.nan), np.zeros(trials), np.ones(trials)
    if k > 1:
        two = np.sort(cost, axis=2)
        margins, agrees = two[:, :, 1] - two[:, :, 0], m.of_children((clip.argmin(axis=2) == slot[:, m.origin]) * 1.0)
        margin, ambiguous, consistency = _ranked(margins, held, 0.5), mean(margins <= AMBIGUOUS * m.between, held, outside), mean(agrees, held, outside)
    counts = ((slot[:, :, None] == np.arange(k)) & train[:, :, None]).sum(axis=1)
    least = np.maximum(SUPPORT_LEAST, np.ceil(np.round(size * SUPPORT_SHARE, 9)).astype(int))
    largest, holdout = sets[top], mean(loss, held, outside)
    far = geometry(m, sets, largest)
    excess, whole = holdout - holdout[top], lambda x: np.full(trials, x)
    out = plan | {
        "k": whole(k), "n_group_children": whole(len(m.children)), "n_group_clips": whole(len(m.ids)), "ids": ids[sets].tolist(), "template_children": children[m.origin[sets]].tolist(),
        "assigned": counts.tolist(), "support_minimum": least, "support_ok": (counts >= least[:, None]).all(axis=1), "exact_match": (sets == largest).all(axis=1),
        "between": whole(m.between), "within": whole(m.within), "train_loss": value, "train_loss_median": _ranked(loss, train, 0.5), "train_loss_p90": _ranked(loss, train, 0.9),
        "train_clip_loss": mean(clip_loss, train, size), "holdout_loss": holdout, "holdout_loss_median": _ranked(loss, held, 0.5), "holdout_p90": _ranked(loss, held, 0.9),
        "holdout_clip_loss": mean(clip_loss, held, outside), "consistency": consistency, "margin": margin, "ambiguous": ambiguous, "largest_loss": holdout[top], "excess": excess,
        "excess_normalized": _over(excess, m.between), "jaccard": _jaccard(sets, largest), "near_overlap": far["near_overlap"], "match_mean": far["match_mean"], "match_max": far["match_max"],
        "match_p90": far["match_p90"], "match_mean_between": _over(far["match_mean"], m.between), "match_mean_within": _over(far["match_mean"], m.within),
        "hausdorff_between": _over(far["hausdorff"], m.between), "nearest_mean_between": _over(far["nearest_mean"], m.between), **agreement(slot, slot[top], far["mapping"], k, held),
    }
    if repetitions > 1:
        next_ = block + (np.arange(trials) - block + 1) % repetitions
        apart = geometry(m, sets, sets[next_])
        alike = agreement(slot, slot[next_], apart["mapping"], k)
        out |= {
            "partner_repetition": next_ - block + 1, "partner_match_mean": apart["match_mean"], "partner_match_mean_between": _over(apart["match_mean"], m.between),
            "partner_hausdorff_between": _over(apart["hausdorff"], m.between), "partner_nearest_between": _over(apart["nearest_mean"], m.between),
            "partner_agreement": alike["agreement"], "partner_ari": alike["ari"], "partner_cluster_jaccard": alike["cluster_jaccard_mean"],
        }
    return out


def matrix_rows(distances: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, `a`, `b`, `distance`: every pair of clips once, and without a distance every clip with its child; of `templates.clip_distances`."""
    if "candidate" not in distances.columns:
        return distances
    pairs = distances.where("segment_id < candidate").select(*keys, F.col("segment_id").alias("a"), F.col("candidate").alias("b"), "distance")
    return pairs.unionByName(named_clips(distances, keys))


def named_clips(clips: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `matrix_rows` that name the child of each of `clips` (`keys`, `segment_id`, `child`)."""
    return clips.select(*keys, F.col("segment_id").alias("a"), F.col("child").alias("b")).distinct().withColumn("distance", F.lit(None).cast("double"))


def _of_matrices(distances: DataFrame, keys: list[str], schema: str, work) -> DataFrame:
    """What `work` gives for every matrix: of `templates.clip_distances` or `matrix_rows`, which a task reads a batch at a time."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distances.schema.fields if f.name in keys)
    columns = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next(batches)
        key = {c: first[c].iloc[0] for c in keys}
        for out in work(Matrix.streamed(chain([first], batches)), "|".join(map(str, key.values()))):
            yield out.reindex(columns=columns).assign(**key)[[*keys, *columns]]

    rows, known = matrix_rows(distances, keys), getattr(distances, "_n_matrices", None)
    return spread(rows, keys, rows.select(*keys).distinct().count() if known is None else known).groupBy(*keys).applyInPandas(run, f"{kinds}, {schema}")


def packed_matrices(distances: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """`distances` of the matrices that a task can pack, and of those that it can't."""
    size = written(distances.groupBy(*keys).agg((F.count_distinct("segment_id") <= MOST_CLIPS).alias("_packed")), "sizes")
    if size.where("NOT _packed").isEmpty():
        return distances, distances.where("false")
    met = distances.join(size, keys)
    return met.where("_packed").drop("_packed"), met.where("NOT _packed").drop("_packed")


def trials(
    distances: DataFrame, keys: list[str], ks: list[int], grid: list[int] = GRID, repetitions: int = REPETITIONS, starts: int = 5, seed: int = SEED, only: str | None = None
) -> DataFrame:
    """One row per trial of every matrix: `keys` and TRIAL.

    A trial does not depend on what else is solved, so fewer `ks`, a smaller `grid` (the largest size is always there)
    or `only` one scheme give a part of the same rows.

    `distances` as `templates.clip_distances` or `matrix_rows`, of matrices of any size.
    Losses are over the children held out; `largest_loss`, `excess`, `match_*`, `agreement`, `ari` and the
    Jaccard indexes compare a trial with that of the same repetition and all training children; `partner_*`
    with the next repetition, of the first after the last, over all children. Groups with too few children
    have no rows. Same input and seed, same trials.
    """
    return _of_matrices(distances, keys, TRIAL, lambda m, name: matrix_trials(m, name, ks, grid, repetitions, starts, seed, only))


#: A point of a curve, as `curve_schema` begins.
POINT = "scheme string, n_children int, maximum int, k int"


def curve_schema(numbers: list[str]) -> str:
    """What a row of `curves` has after the keys."""
    spreads = ", ".join(f"{n}_{x} double" for n in numbers for x in ("mean", "sd", "se", *QUANTILES))
    return f"{POINT}, repetitions long, {spreads}, support_ok_rate double, exact_match_rate double, n_sets long, mode_share double, set_entropy double, marginal double, between double, jaccard_mean double, near_overlap_mean double"


def _percentile(ordered: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """The percentile of each row's first `n` numbers, which are sorted; NaN for none. As Spark's `percentile` reckons it."""
    at, t = np.maximum(n - 1, 0) * share, np.arange(len(ordered))
    low, high = np.floor(at).astype(int), np.ceil(at).astype(int)
    a, b = ordered[t, low], ordered[t, high]
    return np.where(n > 0, np.where((low == high) | (a == b), a, (high - at) * a + (at - low) * b), np.nan)


def _spread(x: np.ndarray) -> dict[str, np.ndarray]:
    """Mean, standard deviation (0 for one value), standard error and quantiles of the known numbers of each row."""
    seen = np.isfinite(x)
    n = seen.sum(axis=1)
    some, ordered = np.where(n > 0, n, np.nan), np.sort(x, axis=1)
    mean = np.where(seen, x, 0.0).sum(axis=1) / some
    sd = np.sqrt(np.where(seen, (x - mean[:, None]) ** 2, 0.0).sum(axis=1) / np.maximum(some - 1, 1))
    return {"mean": mean, "sd": sd, "se": sd / np.sqrt(some)} | {q: _percentile(ordered, n, share) for q, share in QUANTILES.items()}


def curve_of(t: pd.DataFrame, repetitions: int, numbers: list[str]) -> pd.DataFrame:
    """The points of one matrix's curves over its trials `t`: `study.curves` after `resampling.paired_gains`, and what else the study reads of a point."""
    t = t.sort_values(["scheme", "k", "n_children", "repetition"])
    wide = lambda c: t[c].to_numpy(float).reshape(-1, repetitions)
    points = t.iloc[::repetitions][["scheme", "n_children", "maximum", "k", "between"]].reset_index(drop=True)
    loss, at = wide("holdout_loss"), {x: i for i, x in enumerate(zip(points["scheme"], points["k"], points["n_children"]))}
    none = np.full(repetitions, np.nan)
    of = lambda k: np.array([loss[at[s, k(x), n]] if (s, k(x), n) in at else none for s, x, n in at])
    relative = lambda base: np.where(base > 0, (base - loss) / np.where(base > 0, base, 1.0), np.nan)
    follows = np.r_[False, (points["scheme"].to_numpy()[1:] == points["scheme"].to_numpy()[:-1]) & (points["k"].to_numpy()[1:] == points["k"].to_numpy()[:-1])]
    step, fewer = np.diff(points["n_children"], prepend=0), np.vstack([none, loss[:-1]])
    per_child = np.where(follows[:, None], (fewer - loss) / np.where(follows, step, 1)[:, None], np.nan)
    per_child = np.where(points["between"].to_numpy()[:, None] > 0, per_child / points["between"].to_numpy()[:, None], np.nan)
    gains = {"reduction_vs_k1": relative(of(lambda k: 1)), "gain_vs_previous_k": relative(of(lambda k: k - 1)), "gain_per_child_normalized": per_child}
    out = {c: points[c] for c in ("scheme", "n_children", "maximum", "k")} | {"repetitions": repetitions}
    for n in numbers:
        out |= {f"{n}_{q}": x for q, x in _spread(gains[n] if n in gains else wide(n)).items()}
    same = pd.factorize(t["ids"].map("|".join))[0].reshape(-1, repetitions)
    c = (same[:, :, None] == same[:, None, :]).sum(axis=2)  # of each trial, how many have its set
    steepness = np.sort(np.abs(per_child), axis=1)
    mean = lambda x: _spread(wide(x))["mean"]
    return pd.DataFrame(out | {
        "support_ok_rate": wide("support_ok").mean(axis=1), "exact_match_rate": wide("exact_match").mean(axis=1), "n_sets": np.rint((1 / c).sum(axis=1)).astype(int), "mode_share": c.max(axis=1) / repetitions,
        "set_entropy": np.log(repetitions) - np.log(c).sum(axis=1) / repetitions, "marginal": _percentile(steepness, np.isfinite(steepness).sum(axis=1), 0.5), "between": points["between"],
        "jaccard_mean": mean("jaccard"), "near_overlap_mean": mean("near_overlap"),
    })


def curves(
    distances: DataFrame, keys: list[str], numbers: list[str], ks: list[int], grid: list[int] = GRID, repetitions: int = REPETITIONS, starts: int = 5, seed: int = SEED, only: str | None = None
) -> DataFrame:
    """One row per scheme, size and number of templates of every matrix: `keys` and `curve_schema`, of the same trials as `trials`, which stay in the task."""

    def work(m: Matrix, name: str) -> Iterator[pd.DataFrame]:
        for t in matrix_trials(m, name, ks, grid, repetitions, starts, seed, only):
            yield curve_of(t, repetitions, numbers)

    return _of_matrices(distances, keys, curve_schema(numbers), work)


SELECTED = "scheme string, n_children int, k int, segment_id string, n_selected long, frequency double"


def selected(distances: DataFrame, keys: list[str], ks: list[int], grid: list[int] = GRID, repetitions: int = REPETITIONS, starts: int = 5, seed: int = SEED, only: str | None = None) -> DataFrame:
    """`keys` and SELECTED: how often each clip of a matrix is in a set of `trials`, by scheme, size and number of templates; clips never chosen have 0. Sets are solved, not measured."""

    def work(m: Matrix, name: str) -> Iterator[pd.DataFrame]:
        ids, n = np.array(m.ids, object), len(m.ids)
        for solutions in _by_schemes(m, name, ks, grid, repetitions, starts, seed, only):
            for k, plan, train, _, _, sets in solutions:
                block = np.arange(len(train)) // repetitions
                counts = np.bincount((block[:, None] * n + sets).ravel(), minlength=(block[-1] + 1) * n)
                at = np.repeat(np.arange(block[-1] + 1) * repetitions, n)
                yield pd.DataFrame({
                    "scheme": plan["scheme"][at], "n_children": plan["n_children"][at], "k": k, "segment_id": np.tile(ids, block[-1] + 1), "n_selected": counts, "frequency": counts / repetitions,
                })

    return _of_matrices(distances, keys, SELECTED, work)


def solved_templates(distances: DataFrame, keys: list[str], k: int, starts: int = 5, seed: int = SEED) -> DataFrame:
    """`templates.solved_templates` with `objective`, of matrices that a task packs, from their distances: the same starts, swaps and ties."""
    clips = distances.select(*keys, "candidate", "candidate_child").distinct()
    runs = [random_templates(clips, keys, k, seed + 1000 * s).select(*keys, "candidate", F.lit(s).alias("start")) for s in range(1, starts)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distances.schema.fields if f.name in keys)

    def run(rows: pd.DataFrame, begun: pd.DataFrame) -> pd.DataFrame:
        m = Matrix(rows)
        everyone, n, at = np.ones((1, len(m.children)), bool), min(k, len(m.children)), {s: i for i, s in enumerate(m.ids)}
        of_start = [np.array([[at[c] for c in x]]) for _, x in begun.groupby("start")["candidate"]]
        value, sets = _best(m, everyone, [_greedy(m, everyone, n), *of_start], by_ids=True)
        found = pd.DataFrame({"slot": np.arange(n), "candidate": [m.ids[i] for i in sets[0]], "candidate_child": [m.children[m.origin[i]] for i in sets[0]], "objective": value[0]})
        for c in keys:
            found[c] = rows[c].iloc[0]
        return found[[*keys, "slot", "candidate", "candidate_child", "objective"]]

    needed, n = distances.select(*keys, "segment_id", "child", "candidate", "distance"), clips.select(*keys).distinct().count()
    begun = reduce(DataFrame.unionByName, runs) if runs else clips.select(*keys, "candidate", F.lit(0).alias("start")).where("false")
    both = [spread(df, keys, n).groupBy(*keys) for df in (needed, begun)]
    return both[0].cogroup(both[1]).applyInPandas(run, f"{kinds}, slot int, candidate string, candidate_child string, objective double")


FULL = (
    "k int, slot int, segment_id string, child string, n_children int, n_clips int, objective double, loss_mean double, loss_median double, loss_p90 double, clip_loss double, n_assigned int, "
    "support_minimum int, support_ok boolean, assigned_children array<string>, own_loss_mean double, own_loss_median double, own_loss_p90 double, nearest_other double, between double, within double"
)


def full_solutions(distances: DataFrame, keys: list[str], ks: list[int], starts: int = 5, seed: int = SEED) -> DataFrame:
    """One row per template of the sets solved over all children of a matrix, for every k that the children allow: `keys` and FULL.

    `own_loss_*`: losses of the children assigned to the template; `nearest_other`: its distance to the nearest other template.
    """

    def work(m: Matrix, name: str) -> Iterator[pd.DataFrame]:
        everyone = np.arange(len(m.children))[None, :]
        for k in ks:
            if k > len(m.children):
                continue
            value, sets = _full(m, name, k, starts, seed)
            found = evaluated(m, everyone, sets, AMBIGUOUS * m.between)
            counts, least = _support(found["slot"], k)
            own = [m.cost[found["slot"][0] == s, sets[0, s]] for s in range(k)]
            stat = lambda f: [float(f(x)) if len(x) else None for x in own]
            apart = m.known[sets[0][:, None], sets[0][None, :]] + np.where(np.eye(k) > 0, np.inf, 0.0)
            yield pd.DataFrame({
                "k": k, "slot": np.arange(k), "segment_id": [m.ids[i] for i in sets[0]], "child": [m.children[m.origin[i]] for i in sets[0]], "n_children": len(m.children), "n_clips": len(m.ids),
                "objective": value[0], "loss_mean": found["mean"][0], "loss_median": found["median"][0], "loss_p90": found["p90"][0], "clip_loss": found["clip_mean"][0], "n_assigned": counts[0],
                "support_minimum": least, "support_ok": bool((counts[0] >= least).all()), "assigned_children": [[c for c, s in zip(m.children, found["slot"][0]) if s == x] for x in range(k)],
                "own_loss_mean": stat(np.mean), "own_loss_median": stat(np.median), "own_loss_p90": stat(lambda x: np.quantile(x, 0.9)),
                "nearest_other": np.nanmin(apart, axis=1) if k > 1 else np.nan, "between": m.between, "within": m.within,
            })

    return _of_matrices(distances, keys, FULL, work)


def _full(m: Matrix, name: str, k: int, starts: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    return solved(m, np.ones((1, len(m.children)), bool), k, starts, np.random.default_rng([seed, crc32(name.encode()), 900, k]))


STABILITY = "k int, child string, shares array<double>, modal_slot int, entropy double, entropy_normalized double, ambiguous_share double, n_repetitions int, together map<string,double>"


def assignment_stability(distances: DataFrame, keys: list[str], ks: list[int], repetitions: int = REPETITIONS, starts: int = 5, seed: int = SEED) -> DataFrame:
    """How stably children are assigned: per matrix, k and child over the repetitions' largest sets, their slots mapped to those of the solution over all children.

    `keys` and STABILITY: `shares` of the slots, the most frequent one, the entropy and over ln k, how often the choice was
    ambiguous, and for every child from this one on how often both shared a slot (`together`).
    """

    def work(m: Matrix, name: str) -> Iterator[pd.DataFrame]:
        found = dict(schemes(len(m.children)))
        if "primary_h3" not in found:
            return
        n = len(m.children) - found["primary_h3"]
        training = orders(m, name, "primary_h3", repetitions, seed)[:, found["primary_h3"] :]
        train = np.zeros((repetitions, len(m.children)), bool)
        np.put_along_axis(train, training, True, axis=1)
        everyone = np.broadcast_to(np.arange(len(m.children)), train.shape)
        for k in ks:
            if k > n:
                continue
            rng = np.random.default_rng([seed, crc32(name.encode()), crc32(b"primary_h3"), n, k])
            _, sets = solved(m, train, k, starts, rng)
            _, full = _full(m, name, k, starts, seed)
            mapping = geometry(m, sets, np.broadcast_to(full[0], sets.shape))["mapping"]
            slot = evaluated(m, everyone, sets, 0.0)["slot"]
            mapped = mapping[np.arange(repetitions)[:, None], slot]
            shares = (mapped[:, :, None] == np.arange(k)).mean(axis=0)
            entropy = -np.where(shares > 0, shares * np.log(np.maximum(shares, 1e-300)), 0.0).sum(axis=1)
            close = np.zeros(len(m.children))
            if k > 1:
                cost = np.sort(m.cost[:, sets].transpose(1, 0, 2), axis=2)
                close = (cost[:, :, 1] - cost[:, :, 0] <= AMBIGUOUS * m.between).mean(axis=0)
            both = (mapped[:, :, None] == mapped[:, None, :]).mean(axis=0)
            yield pd.DataFrame({
                "k": k, "child": m.children, "shares": list(shares), "modal_slot": shares.argmax(axis=1), "entropy": entropy + 0.0, "entropy_normalized": entropy / np.log(k) if k > 1 else 0.0,
                "ambiguous_share": close, "n_repetitions": repetitions, "together": [dict(zip(m.children[i:], both[i, i:].tolist())) for i in range(len(m.children))],
            })

    return _of_matrices(distances, keys, STABILITY, work)
