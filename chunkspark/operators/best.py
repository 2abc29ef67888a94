"""Exact cosine top-k of hashed bags of words, for many queries in one pass over the index.

The queries are a tree: their (bucket, weight) steps, the most frequent ones first, so that queries with common words
share sums. A block of index rows is a matrix with a line per bucket; a query adds the lines of its buckets, and only
rows that can still be among its best k get their exact score. Each task keeps k rows per query and group and gives
them at its end. Nothing is cut: a row that is passed over scores less than k others.
"""

from __future__ import annotations

import heapq
import re
from bisect import insort
from collections import Counter
from collections.abc import Callable
from hashlib import md5
from typing import Any

import numpy as np

#: Most rows of a block, and most cells of its matrix; parts of a block whose largest scores bound the k-th from below.
ROWS, CELLS = 8192, 2**22
PARTS = 64
#: Of ``Grouped``: rows that share a bound, queries taken together, most stems, and rows of a block.
GROUP, BATCH, STEMS, PACKED = 16, 128, 64, 8192
#: Scores that may be equal after rounding differ less, single-precision errors included.
_NEAR = 2e-6
_EXACT = float(2**24)  # whole numbers below are exact in single precision
_WORDS = re.compile(r"[^\W_]+")  # letters and numbers of any script
_PLAIN = re.compile("[a-z0-9]+")


def _true(flags: np.ndarray) -> np.ndarray:
    """Places of the few that hold in an array of a multiple of 8 flags."""
    words = np.flatnonzero(flags.reshape(-1).view(np.uint64))
    inside = np.flatnonzero(flags.reshape(-1, 8)[words])
    return words[inside >> 3] * 8 + (inside & 7)


class Buckets(dict):
    """Token -> bucket, as in ``search.bucket``; remembered by the Python worker."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: str) -> int:
        self[token] = value = int(md5(token.encode()).hexdigest()[:8], 16) % self.dim
        return value


def hashed(texts: list[str], buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word of texts in small letters."""
    if len(buckets) > 1_000_000:
        buckets.clear()
    found = [_WORDS.findall(t) for t in texts]
    flat = [buckets[w] for words in found for w in words]
    return np.repeat(np.arange(len(texts)), [len(w) for w in found]), np.asarray(flat, np.int64)


class Pieces(dict):
    """Text without a full stop -> buckets of its words. Chunks of several methods are made of the same sentences."""

    def __init__(self, buckets: Buckets):
        self.buckets, self.words = buckets, 0

    def __missing__(self, piece: str) -> np.ndarray:
        buckets = self.buckets
        self[piece] = value = np.array([buckets[w] for w in _WORDS.findall(piece)], np.int32)
        self.words += len(value)
        return value

    def of(self, text: str) -> np.ndarray:
        """Buckets of the words of a text in small letters, as in ``hashed``: no word goes over a full stop."""
        if self.words + len(self) > 2_000_000:
            self.clear()
            self.words = 0
        if len(self.buckets) > 1_000_000:
            self.buckets.clear()
        return np.concatenate([self[p] for p in text.split(".")])


def plain(text: str) -> str:
    """The match form (see ``functions.text``) of a text in small letters."""
    return " ".join(_PLAIN.findall(text))


def rounded(score: np.ndarray) -> np.ndarray:
    """To 6 places, halves away from zero."""
    v = score * 1e6
    low = np.floor(v)
    return (low + (v - low >= 0.5)) / 1e6


def tree(bags: list[dict[int, float]]) -> dict[str, Any]:
    """The queries in the order of the tree: place in ``bags``, common steps with the one before, further steps, length."""
    often = Counter(step for bag in bags for step in bag.items())
    paths = [sorted(bag.items(), key=lambda step: (-often[step], step)) for bag in bags]
    order = sorted((i for i, p in enumerate(paths) if p), key=lambda i: [(-often[s], s) for s in paths[i]])
    shared, steps, before = [], [], []
    for i in order:
        n = next((d for d, (x, y) in enumerate(zip(before, paths[i])) if x != y), min(len(before), len(paths[i])))
        shared.append(n)
        steps.append(paths[i][n:])
        before = paths[i]
    norms = [float(np.sqrt(sum(w * w for w in bags[i].values()))) for i in order]
    return {"order": order, "shared": shared, "steps": steps, "norms": norms, "depth": max(map(len, paths), default=0)}


def listed(bags: list[dict[int, float]]) -> dict[str, Any]:
    """The queries one by one, as a tree without common steps."""
    order = [i for i, bag in enumerate(bags) if bag]
    norms = [float(np.sqrt(sum(w * w for w in bags[i].values()))) for i in order]
    return {"order": order, "shared": [0] * len(order), "steps": [list(bags[i].items()) for i in order], "norms": norms, "depth": max(map(len, bags), default=0)}


class Best:
    """The best k rows of each query of a ``tree`` and group. With ``needles`` (match forms, per query), a row also has
    whether some needle occurs in its text; with ``positive``, rows without a common bucket don't count."""

    def __init__(self, asked: dict[str, Any], k: int, dim: int, needles: list[list[str]] | None = None, positive: bool = False):
        self.asked, self.k, self.dim, self.needles, self.positive = asked, k, max(1, dim), needles, positive
        self.size = max(PARTS, min(ROWS, CELLS // self.dim // PARTS * PARTS))
        self.found: dict[Any, list[list[tuple]]] = {}
        self.least: dict[Any, list[float]] = {}
        self.sums: dict[Any, list[np.ndarray]] = {}

    def add(self, by: Any, ids: list, row: np.ndarray, bucket: np.ndarray, tf: np.ndarray | None = None, texts: list[str] | None = None) -> None:
        """Up to ``size`` rows of group ``by`` in the order of their ids, with (row, bucket) of each word, or with counts
        ``tf``; buckets below 0 are none of the queries'."""
        size = self.size
        known = bucket >= 0
        cells = np.bincount((bucket * size + row)[known], None if tf is None else tf[known], minlength=self.dim * size).reshape(self.dim, size)
        if tf is None:
            squares = np.zeros(size)
            for i in range(0, self.dim, 64):
                squares += np.einsum("ij,ij->j", cells[i : i + 64], cells[i : i + 64])
        else:
            squares = np.bincount(row, tf * tf, minlength=size)
        norm = np.sqrt(squares)
        real = norm > 0  # rows without words are no rows of the index
        kind = np.float32 if norm.max() * max(self.asked["norms"], default=0) < _EXACT else np.float64
        lines = cells.astype(kind)
        inverse = np.divide(1, norm, out=np.zeros(size), where=real).astype(kind)
        if kind not in self.sums:
            self.sums[kind] = [np.zeros(size, kind) for _ in range(self.asked["depth"] + 1)]
        sums, cosine, step_sum = self.sums[kind], np.empty(size, kind), np.empty(size, kind)
        found = self.found.setdefault(by, [[] for _ in self.asked["order"]])
        least = self.least.setdefault(by, [-1.0] * len(found))
        k, norms = self.k, self.asked["norms"]
        places, at, dots = [], [], []
        zero_rows = np.flatnonzero(real)
        for j, (depth, steps) in enumerate(zip(self.asked["shared"], self.asked["steps"])):
            for b, w in steps:
                if w == 1:
                    np.add(sums[depth], lines[b], out=sums[depth + 1])
                else:
                    np.multiply(lines[b], w, out=step_sum)
                    np.add(sums[depth], step_sum, out=sums[depth + 1])
                depth += 1
            np.multiply(sums[depth], inverse, out=cosine)
            bound = least[j] * norms[j]
            if bound >= 0:  # k rows are known
                most = cosine.max()
                if most < bound - _NEAR * norms[j]:
                    continue
            if k <= PARTS:
                tops = cosine.reshape(PARTS, -1).max(axis=1)
                bound = max(bound, float(tops.max() if k == 1 else np.partition(tops, PARTS - k)[PARTS - k]))
            bound -= _NEAR * norms[j]
            if bound > 0:
                some = (cosine >= bound).nonzero()[0]
            else:
                some = (cosine > 0).nonzero()[0]
                if len(some) < k and not self.positive:
                    first = zero_rows[: k + len(some)]
                    some = np.union1d(some, first)
            if len(some):
                places.append(j)
                at.append(some)
                dots.append(sums[depth][some])
        if not at:
            return
        place, some = np.repeat(places, [len(x) for x in at]), np.concatenate(at)
        score = rounded(np.concatenate(dots).astype(np.float64) / (norm[some] * np.asarray(norms)[place]))
        order = np.lexsort((some, -score, place))
        place, some, score = place[order], some[order], score[order]
        start = np.maximum.accumulate(np.where(np.r_[True, place[1:] != place[:-1]], np.arange(len(place)), 0))
        first = np.arange(len(place)) - start < k
        forms: dict[int, str] = {}
        for j, i, s in zip(place[first].tolist(), some[first].tolist(), score[first].tolist()):
            own = found[j]
            if len(own) == k and (-s, ids[i]) >= own[-1][:2]:
                continue
            hit = False
            if self.needles is not None:
                if i not in forms:
                    forms[i] = plain(texts[i])
                hit = any(needle in forms[i] for needle in self.needles[self.asked["order"][j]])
            own.append((-s, ids[i], hit))
            own.sort(key=lambda x: x[:2])
            del own[k:]
            if len(own) == k:
                least[j] = -own[-1][0]

    def rows(self) -> list[tuple[int, Any, Any, float, bool]]:
        """(place of the query, group, id, score, hit)"""
        order = self.asked["order"]
        return [(order[j], by, key, -s, hit) for by, all_ in self.found.items() for j, own in enumerate(all_) for s, key, hit in own]


class Bounded(Best):
    """The same for whole-numbered queries, with rows that several groups share. The sums are whole numbers of 16 bits
    (32 for long queries), rounded up, that bound the scores from above; only rows whose bound reaches the best k get a
    score."""

    form = staticmethod(plain)

    def __init__(self, asked: dict[str, Any], k: int, dim: int, needles: list[list[str]] | None = None, positive: bool = False):
        super().__init__(asked, k, dim, needles, positive)
        paths: list[list[tuple[int, int]]] = []
        for depth, steps in zip(asked["shared"], asked["steps"]):
            paths.append([*(paths[-1][:depth] if depth else []), *steps])
        self.norms = np.asarray(asked["norms"], np.float64)
        self.query_buckets, self.query_weights = (np.zeros((asked["depth"], len(paths)), np.int64) for _ in range(2))
        for j, path in enumerate(paths):
            self.query_buckets[: len(path), j], self.query_weights[: len(path), j] = zip(*path)
        self.weight = self.query_weights.sum(axis=0)  # a sum is above the score by less than this
        most = int(self.weight.max(initial=0))
        self.kind = np.int16 if most < 2048 else np.int32
        self.scale = (np.iinfo(self.kind).max - 16 - most) / self.norms.max(initial=1)

    def add_shared(self, by: list, ids: list[list], row: np.ndarray, bucket: np.ndarray, texts: list[str]) -> None:
        """Up to ``size`` rows with (row, bucket) of each word that all groups of ``by`` have, each under ids of its own;
        the rows stand in the order of the first group's ids."""
        if not len(self.norms) or not len(bucket):
            return
        k, n = self.k, len(texts)
        size = -(-n // PARTS) * PARTS
        cells = np.bincount(bucket * size + row, minlength=self.dim * size).reshape(self.dim, size)
        squares = np.zeros(size, np.int64)
        lines = np.empty((self.dim, size), self.kind)
        for i in range(0, self.dim, 64):
            squares += np.einsum("ij,ij->j", cells[i : i + 64], cells[i : i + 64])
        norm = np.sqrt(squares)
        per = np.divide(self.scale, norm, out=np.zeros(size), where=norm > 0)
        for i in range(0, self.dim, 64):
            lines[i : i + 64] = np.ceil(cells[i : i + 64] * per)
        real = np.flatnonzero(norm)  # rows without words are no rows of the index
        for g in by:
            self.found.setdefault(g, [[] for _ in self.norms])
            self.least.setdefault(g, np.full(len(self.norms), -1.0))
        least = np.min([self.least[g] for g in by], axis=0)
        goals = np.floor((least - _NEAR) * self.norms * self.scale).astype(np.int64).tolist()
        below = (np.ceil(_NEAR * self.norms * self.scale).astype(np.int64) + self.weight + 1).tolist()
        orders = [None, *[sorted(range(n), key=each.__getitem__) for each in ids[1:]]]
        firsts = np.unique([i for o in orders for i in (real if o is None else [i for i in o if norm[i]])[: 2 * k]])
        same = all(o is None or o == list(range(n)) for o in orders)
        sums, step_sum = [np.zeros(size, self.kind) for _ in range(self.asked["depth"] + 1)], np.empty(size, self.kind)
        places, at = [], []
        for j, (depth, steps) in enumerate(zip(self.asked["shared"], self.asked["steps"])):
            for b, w in steps:
                if w == 1:
                    np.add(sums[depth], lines[b], out=sums[depth + 1])
                else:
                    np.multiply(lines[b], self.kind(w), out=step_sum)
                    np.add(sums[depth], step_sum, out=sums[depth + 1])
                depth += 1
            bound, goal = sums[depth], goals[j]
            if goal > 0 and np.maximum.reduce(bound) < goal:
                continue
            if k <= PARTS:
                tops = np.maximum.reduce(bound.reshape(-1, PARTS), axis=0)
                tops.partition(PARTS - k)
                goal = max(goal, int(tops[PARTS - k]) - below[j])
            if goal > 0:
                some = (bound >= goal).nonzero()[0]
            else:
                some = bound.nonzero()[0]
                if len(some) < k and not self.positive:
                    some = np.union1d(some, firsts)
            if len(some):
                places.append(j)
                at.append(some)
        if not at:
            return
        place, some = np.repeat(places, [len(x) for x in at]), np.concatenate(at)
        self._keep(by, ids, texts, place, some, cells, norm, least, same)

    def _keep(self, by: list, ids: list[list], texts: list[str], place: np.ndarray, some: np.ndarray, cells: np.ndarray, norm: np.ndarray, least: np.ndarray, same: bool) -> None:
        """Exact scores of rows ``some`` for the queries ``place``; the best of them are kept."""
        k, size = self.k, cells.shape[1]
        flat, dot = cells.ravel(), np.zeros(len(some), np.int64)
        for buckets, weights in zip(self.query_buckets, self.query_weights):
            dot += flat[buckets[place] * size + some] * weights[place]
        score = rounded(dot / (norm[some] * self.norms[place]))
        use = score >= least[place]
        place, some, score = place[use], some[use], score[use]
        order = np.lexsort((some, -score, place))
        place, some, score = place[order], some[order], score[order]
        start = np.maximum.accumulate(np.where(np.r_[True, place[1:] != place[:-1]], np.arange(len(place)), 0)) if len(place) else place
        first = np.arange(len(place)) - start < k
        if not same:  # ties may be in another order elsewhere
            first |= score == score[np.minimum(start + k - 1, len(score) - 1)]
        place, some, score = place[first], some[first], score[first]
        forms: dict[int, str] = {}
        for g, own_ids in zip(by, ids):
            all_, lowest = self.found[g], self.least[g]
            use = score >= lowest[place]
            for j, i, s in zip(place[use].tolist(), some[use].tolist(), score[use].tolist()):
                own = all_[j]
                if len(own) == k and (-s, own_ids[i]) >= own[-1][:2]:
                    continue
                hit = False
                if self.needles is not None:
                    if i not in forms:
                        forms[i] = self.form(texts[i])
                    form = forms[i]
                    for needle in self.needles[self.asked["order"][j]]:
                        if needle in form:
                            hit = True
                            break
                insort(own, (-s, own_ids[i], hit))
                del own[k:]
                if len(own) == k:
                    lowest[j] = -own[-1][0]


class Grouped(Bounded):
    """The same for very many queries that begin with one of few ``stems`` (bags; None for none). Rows alike are packed
    side by side and ``GROUP`` of them share a bound, the largest of each bucket; rows are looked at only in groups
    whose bound reaches the best k. Queries are taken ``BATCH`` at a time, without a step per query. The texts are match
    forms."""

    form = staticmethod(lambda text: text)

    def __init__(self, asked: dict[str, Any], k: int, dim: int, needles: list[list[str]] | None = None, bags: list[dict[int, int]] = (), stems: list[dict[int, int] | None] = ()):
        super().__init__(asked, k, dim, needles)
        known: dict[tuple, int] = {(): 0}
        rest = []
        self.stem = np.zeros(len(asked["order"]), np.int64)
        for j, i in enumerate(asked["order"]):
            bag, stem = bags[i], stems[i] or {}
            steps = tuple(sorted(stem.items()))
            if any(bag.get(b, 0) < w for b, w in steps) or len(known) > STEMS and steps not in known:
                stem, steps = {}, ()
            self.stem[j] = known.setdefault(steps, len(known))
            rest.append([b for b, w in bag.items() for _ in range(w - stem.get(b, 0))])
        self.stems = list(known)
        self.asked = {**asked, "steps": [], "shared": []}  # not needed any more, but large
        # Queries with about as many further steps go together; a bucket behind the last one holds nothing.
        self.turn = np.argsort([len(r) for r in rest], kind="stable")
        self.rest = [np.array([r + [dim] * (max(len(rest[i]) for i in part) - len(r)) for r in (rest[i] for i in part)], np.int64).T for part in self._parts()]

    def _parts(self) -> list[np.ndarray]:
        return [self.turn[i : i + BATCH] for i in range(0, len(self.turn), BATCH)]

    def add_packed(self, by: list, ids: list[list], row: np.ndarray, bucket: np.ndarray, tf: np.ndarray, texts: list[str]) -> None:
        """Rows with (row, bucket, count) of their words, which all groups of ``by`` have, each under ids of its own."""
        if not len(self.norms) or not len(bucket):
            return
        k, n = self.k, len(texts)
        size = -(-n // (8 * GROUP)) * 8 * GROUP
        n_groups = size // GROUP
        norm = np.sqrt(np.bincount(row, tf.astype(np.float64) ** 2, minlength=size))
        per = np.divide(self.scale, norm, out=np.zeros(size), where=norm > 0)
        cells = np.zeros((self.dim, size), np.int32)
        cells[bucket, row] = tf
        lines = np.zeros((self.dim + 1, size), self.kind)
        lines[bucket, row] = np.ceil(tf * per[row])
        stems = np.zeros((len(self.stems), size), self.kind)
        for i, steps in enumerate(self.stems):
            for b, w in steps:
                stems[i] += lines[b] * self.kind(w)
        groups, stem_groups = (x.reshape(len(x), n_groups, GROUP).max(axis=2) for x in (lines, stems))
        lines, stems = lines.reshape(-1, GROUP), stems.reshape(-1, GROUP)
        for g in by:
            self.found.setdefault(g, [[] for _ in self.norms])
            self.least.setdefault(g, np.full(len(self.norms), -1.0))
        least = np.min([self.least[g] for g in by], axis=0)
        goals = np.maximum(1, np.floor((least - _NEAR) * self.norms * self.scale)).astype(self.kind)
        below = np.ceil(_NEAR * self.norms * self.scale).astype(np.int64) + self.weight + 1
        few = -(-k // GROUP) + 3  # groups that bound the k-th best from below

        def sums(place: np.ndarray, rest: np.ndarray, group: np.ndarray) -> np.ndarray:
            out = stems.take(self.stem[place] * n_groups + group, axis=0)
            one = np.empty_like(out)
            for b in rest:
                out += lines.take(b * n_groups + group, axis=0, out=one, mode="clip")
            return out

        places, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part, rest in zip(self._parts(), self.rest):
            bound, goal = stem_groups.take(self.stem[part], axis=0), goals[part]
            one = np.empty_like(bound)
            for b in rest:
                bound += groups.take(b, axis=0, out=one, mode="clip")
            reached = bound >= goal[:, None]
            many = np.flatnonzero(np.add.reduce(reached.view(np.int8), axis=1, dtype=np.int32) > np.where(goal == 1, 2 * few, 16 * few))
            if len(many):
                wide = n_groups // few  # the best group of each of ``few`` parts
                top = bound[many][:, : few * wide].reshape(-1, few, wide).argmax(axis=2) + np.arange(few) * wide
                of = np.repeat(many, few)
                inside = sums(part[of], rest[:, of], top.ravel()).reshape(len(many), -1)
                inside.partition(inside.shape[1] - k, axis=1)
                goal[many] = np.maximum(goal[many], inside[:, -k] - below[part[many]]).astype(self.kind)
                reached[many] = bound[many] >= goal[many, None]
            of, group = np.divmod(_true(reached), n_groups)
            for i in range(0, len(of), 2**17):
                o, g = of[i : i + 2**17], group[i : i + 2**17]
                pair, inside = np.divmod(_true(sums(part[o], rest[:, o], g) >= goal[o][:, None]), GROUP)
                places.append(part[o[pair]])
                at.append(g[pair] * GROUP + inside)
        place, some = np.concatenate(places), np.concatenate(at)
        # Where fewer than k rows with a common bucket are known, rows without one fill up in the order of their ids.
        poor = np.flatnonzero((least <= 0) & (np.bincount(place, minlength=len(least)) < k))
        if len(poor):
            real = np.flatnonzero(norm).tolist()
            firsts = np.unique([i for each in ids for i in heapq.nsmallest(2 * k, real, key=each.__getitem__)])
            place, some = np.r_[place, np.repeat(poor, len(firsts))], np.r_[some, np.tile(firsts, len(poor))]
            place, some = np.divmod(np.unique(place * size + some), size)
        if len(place):
            self._keep(by, ids, texts, place, some, cells, norm, least, False)


def packed(rows: list[np.ndarray], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words of each row -> order of the rows, by the most frequent bucket and the norm, and per distinct
    bucket of the rows in this order (row, bucket, count)."""
    place = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cell, tf = np.unique(place * dim + np.concatenate(rows), return_counts=True)
    row, bucket = np.divmod(cell, dim)
    norm = np.bincount(row, tf * tf, minlength=len(rows))
    most = np.full(len(rows), -1)
    often = np.lexsort((bucket, tf, row))
    last = np.r_[row[often][1:] != row[often][:-1], True] if len(row) else np.zeros(0, bool)
    most[row[often][last]] = bucket[often][last]
    order = np.lexsort((norm, most))
    at = np.empty(len(rows), np.int64)
    at[order] = np.arange(len(rows))
    turn = np.argsort(at[row], kind="stable")
    return order, at[row][turn], bucket[turn], tf[turn]


class Waiting:
    """Rows of each group until there are ``size`` of them."""

    def __init__(self, size: int, use: Callable[[Any, list[tuple]], None]):
        self.size, self.use, self.rows = size, use, {}

    def add(self, by: Any, row: tuple) -> None:
        own = self.rows.setdefault(by, [])
        own.append(row)
        if len(own) == self.size:
            self.use(by, self.rows.pop(by))

    def part(self, least: int) -> None:
        """Rows that several groups share, but fewer than ``least`` of them, wait once for each group."""
        for by in [x for x, rows in self.rows.items() if len(x) > 1 and len(rows) < least]:
            for ids, value in self.rows.pop(by):
                for g, key in zip(by, ids):
                    self.add((g,), ((key,), value))

    def end(self) -> None:
        while self.rows:
            self.use(*self.rows.popitem())
