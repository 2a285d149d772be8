"""Hard negatives by inner product, from cover trees.

For an anchor, its positives are the rows of its own label with the highest scores; for each positive, the hard
negatives are the rows of other labels with the highest scores inside a window below the positive's score.

1. Vectors become whole numbers, so scores are exact. One component more gives all candidates of a tree the same
   norm; the anchor's is 0 there, so scores stay, and the nearer a candidate is, the higher is its score.
2. Candidates are dealt by a hash of their id into groups of bounded size; each group has a cover tree. A node of
   level i covers its members within a radius that shrinks from level to level; the centres of one level are
   farther apart than that radius. Centres are members, so a node of one member is its centre.
3. All candidates lie on a sphere, so the angle to a centre and the node's radius, as an angle, give the highest and
   lowest score a member can have. The descent opens the node with the highest bound first and ends as soon as no bound can reach what is found
   already. Nodes whose scores all lie outside the window are skipped; those of few members are verified exactly.
4. Anchors go to all groups in blocks of bounded size. Each group sends its best few for each anchor; windows
   merge them. A second descent looks for the negatives of all positives of an anchor at once.

Every row is indexed and no anchor, candidate or window is left out: the result is exact.

Cases: rows without id, label or vector, and rows with a null or non-finite component take no part. An id that
repeats counts once, with its least label, then vector. Shorter vectors count as filled up with zeros. Equal scores
stand by the smaller id. Scores beyond 64 bits count as the end of that range. An empty table gives an empty table.
Other columns take no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from banterscope.session import materialise

# Rows of a group, and anchors of a block: what one task holds. Smaller tables are cut into GROUPS.
MOST_ROWS = 1 << 16
FEWEST_ROWS = 1 << 12
GROUPS = 32
BLOCK = 1 << 13
# Nodes of so many members have no children.
LEAF = 512
# From one level to the next a radius shrinks by this.
SHRINK = 0.95
# Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def whole(vector: Column) -> Column:
    """Components as whole numbers, in 256ths, rounded down."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))


class CoverTree:
    """Nodes over the rows of a matrix of whole numbers; members of a node stand side by side in ``order``."""

    def __init__(self, vectors: np.ndarray) -> None:
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.norm = float(norms.max(initial=0.0))
        self.augmented = np.concatenate([vectors, np.sqrt(np.maximum(self.norm - norms, 0))[:, None]], 1)
        self.order = np.arange(len(vectors))
        # Of each node: its centre, radius, members from and to, children from and to.
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int]] = []
        if len(vectors):
            self._add(0, np.arange(len(vectors)), 0)
            self._grow()
        self.centres, self.radii = np.array(self.centre, np.int64), np.array(self.radius)
        # Leaves are read as runs of rows.
        self.augmented = self.augmented[self.order]
        self.place = np.empty(len(vectors), np.int64)
        self.place[self.order] = np.arange(len(vectors))
        self.points = self.augmented[self.place[self.centres]] if len(vectors) else self.augmented

    def _far(self, centre: int, members: np.ndarray) -> np.ndarray:
        """Distances, from products: all norms are alike."""
        return np.sqrt(np.maximum(2 * self.norm - 2 * (self.augmented[members] @ self.augmented[centre]), 0))

    def _add(self, centre: int, members: np.ndarray, start: int, far: np.ndarray | None = None) -> None:
        far = self._far(centre, members) if far is None else far
        self.centre.append(centre)
        self.radius.append(float(far.max()) + 1e-7 * math.sqrt(self.norm))  # products round
        self.span.append((start, start + len(members)))
        self.children.append((0, 0))
        self.order[start : start + len(members)] = members

    def _grow(self) -> None:
        """Covers every node by children of the next smaller radius: always the member farthest from all centres."""
        at = 0
        while at < len(self.centre):  # children join at the end
            start, stop = self.span[at]
            # Copies of one vector have no radius but what rounding leaves, and no children.
            if stop - start > LEAF and self.radius[at] > 1e-6 * math.sqrt(self.norm):
                members = self.order[start:stop].copy()
                centres, nearest = [self.centre[at]], np.zeros(len(members), np.int64)
                own = self.augmented[members]
                far = self._far(self.centre[at], members)
                goal = self.radius[at] * SHRINK
                while far.max() > goal:
                    centres.append(int(members[far.argmax()]))
                    near = np.sqrt(np.maximum(2 * self.norm - 2 * (own @ self.augmented[centres[-1]]), 0))
                    closer = near < far
                    far[closer], nearest[closer] = near[closer], len(centres) - 1
                self.children[at] = (len(self.centre), len(self.centre) + len(centres))
                by = np.argsort(nearest, kind="stable")
                cuts = np.searchsorted(nearest[by], np.arange(len(centres) + 1))
                for k, centre in enumerate(centres):
                    part = by[cuts[k] : cuts[k + 1]]
                    self._add(centre, members[part], start + int(cuts[k]), far[part])
            at += 1


class Group:
    """The rows of a group with their tree."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        tree = CoverTree(vectors)
        self.tree, self.ids, self.labels, self.vectors = tree, ids[tree.order], labels[tree.order], vectors[tree.order]
        self.largest = float(np.abs(vectors).max(initial=0.0))

    def scores(self, rows: slice, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products, within 64 bits."""
        if self.largest * self.largest * len(anchor) < EXACT and max(-anchor.min(initial=0.0), anchor.max(initial=0.0)) <= self.largest:
            return self.vectors[rows] @ anchor
        return np.array([max(-_LONG - 1, min(_LONG, sum(int(a) * int(b) for a, b in zip(row, anchor)))) for row in self.vectors[rows]], object)

    def asked(self, asks: pa.Table) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """The anchors' numbers and vectors with their bounds, some at a time."""
        wide = self.vectors.shape[1]
        for start in range(0, len(asks), 1024):
            part = _matrix(asks.column("asks").slice(start, 1024), wide)
            yield from enumerate(zip(part, *self.bounds(part)), start)

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest and lowest scores that the members of each node can have with each anchor."""
        tree = self.tree
        scale = np.sqrt(np.einsum("ij,ij->i", anchors, anchors) * tree.norm)[:, None]
        cosine = anchors @ tree.points[:, : anchors.shape[1]].T / np.maximum(scale, 1e-300)
        angle = np.arccos(np.clip(cosine, -1, 1))
        reach = 2 * np.arcsin(np.minimum(tree.radii / max(2 * math.sqrt(tree.norm), 1e-300), 1))
        slack = 1e-7 * scale + 0.5  # more than roundings make
        top, bottom = scale * np.cos(np.maximum(angle - reach, 0)) + slack, scale * np.cos(np.minimum(angle + reach, np.pi)) - slack
        # Scores end at 64 bits, so bounds don't go beyond either.
        return np.maximum(top, -_LONG / 2), np.minimum(bottom, _LONG / 2)

    def best(self, anchor: np.ndarray, tops: np.ndarray, bottoms: np.ndarray, count: int, windows: list[tuple[float, float]], wanted: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each window of scores (both ends included) the first ``count`` rows, by score, then id, as (score, -id).

        ``tops`` and ``bottoms`` are the anchor's bounds, ``wanted`` says which rows count. One descent serves all windows.
        """
        found: list[list[tuple[int, int]]] = [[] for _ in windows]  # heaps: the worst stands first
        tree, top, bottom = self.tree, tops.tolist(), bottoms.tolist()
        windows = [(low, high) if low <= high else (math.inf, -math.inf) for low, high in windows]

        def least() -> float:
            """The lowest score that some window still takes."""
            return min(max(low, held[0][0]) if len(held) == count else low for (low, _), held in zip(windows, found))

        most = max(high for _, high in windows)
        queue = [(-top[0], 0)] if top else []
        while queue:
            best, node = heapq.heappop(queue)
            bar = least()
            if -best < bar:
                break
            if bottom[node] > most:
                continue
            first, last = tree.children[node]
            if first < last:
                for child in range(first, last):
                    if top[child] >= bar and bottom[child] <= most:
                        heapq.heappush(queue, (-top[child], child))
                continue
            start, stop = tree.span[node]
            scores = self.scores(slice(start, stop), anchor)
            good = (scores >= bar) & wanted[start:stop]
            if not good.any():
                continue
            hits = np.flatnonzero(good & (scores <= most))
            for k in hits[np.argsort(-scores[hits], kind="stable")].tolist():
                entry = (int(scores[k]), -int(self.ids[start + k]))
                if entry[0] < bar:
                    break
                for (low, high), held in zip(windows, found):
                    if low <= entry[0] <= high:
                        if len(held) < count:
                            heapq.heappush(held, entry)
                        elif entry > held[0]:
                            heapq.heapreplace(held, entry)
                bar = least()
        return found


def _matrix(lists: pa.ChunkedArray, wide: int) -> np.ndarray:
    """Vectors as rows of ``wide`` numbers: filled up with zeros, and without what stands beyond."""
    array = lists.combine_chunks()
    sizes = np.diff(array.offsets.to_numpy())
    row = np.repeat(np.arange(len(array)), sizes)
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, inside = np.zeros((len(array), wide)), column < wide
    out[row[inside], column[inside]] = array.flatten().to_numpy(zero_copy_only=False)[inside]
    return out


def _held(table: pa.Table) -> Group:
    wide = pc.max(pc.list_value_length(table.column("vector"))).as_py()
    return Group(table.column("id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("vector"), wide))


def _dealt(rows: DataFrame, groups: int) -> DataFrame:
    return rows.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(groups)))


def _asked(anchors: DataFrame, groups: int) -> DataFrame:
    """Anchors for every group, in blocks."""
    return anchors.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))


def _searched(rows: DataFrame, anchors: DataFrame, groups: int, blocks: int, search, schema: str) -> DataFrame:
    """``search(group, anchors)`` for every group and every block of anchors."""
    block = F.pmod(F.xxhash64(F.lit("block"), "anchor"), F.lit(blocks)).alias("block")
    one = _dealt(rows, groups).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    two = _asked(anchors, groups).select("*", block)
    kind = pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(search(_held(left), right)) if len(left) else []
        return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(len(kind))], kind)

    return one.groupBy("cell", "block").cogroup(two.groupBy("cell", "block")).applyInArrow(run, schema)


def hard_negatives(
    rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", anchors: Column | None = None,
    positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, parts: int = 100,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` tells which rows are asked for (all, if None). A negative's score is from ``least`` to ``most``
    ``parts`` of its positive's, so ``parts`` is positive.
    """
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    good = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite
    asked = F.lit(True) if anchors is None else anchors
    plain = rows.where(good).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole(F.col(vector)).alias("vector"), asked.alias("asked"))
    once = plain.groupBy("id").agg(F.min(F.struct("label", "vector", "asked")).alias("r"))
    own = materialise(once.select("id", "r.label", "r.vector", "r.asked"), "vectors")
    total, many = own.agg(F.count("*"), F.count_if("asked")).first()
    size = min(MOST_ROWS, max(FEWEST_ROWS, math.ceil(total / GROUPS)))
    groups, blocks = max(1, math.ceil(total / size)), max(1, math.ceil(many / BLOCK))
    candidates = own.select("id", "label", "vector")
    questions = own.where("asked").select(F.col("id").alias("anchor"), F.col("label").alias("own"), F.col("vector").alias("asks"))

    def near(group: Group, asks: pa.Table) -> Iterator[tuple]:
        for at, (q, top, bottom) in group.asked(asks):
            anchor = asks.column("anchor")[at].as_py()
            wanted = (group.labels == asks.column("own")[at].as_py()) & (group.ids != anchor)
            for score, other in group.best(q, top, bottom, positives, [(-math.inf, math.inf)], wanted)[0]:
                yield anchor, -other, score

    found = _searched(candidates, questions, groups, blocks, near, "anchor long, positive long, score long")
    place = F.row_number().over(W.partitionBy("anchor").orderBy(F.col("score").desc(), "positive"))
    pairs = materialise(found.withColumn("_place", place).where(F.col("_place") <= positives).drop("_place"), "positives")

    # A window for each positive: every anchor carries its own few.
    told = pairs.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("score", "positive"))).alias("pairs"))
    windows = questions.join(told, "anchor")

    def far(group: Group, asks: pa.Table) -> Iterator[tuple]:
        for at, (q, top, bottom) in group.asked(asks):
            anchor, own = asks.column("anchor")[at].as_py(), asks.column("own")[at].as_py()
            scores = sorted({p["score"] for p in asks.column("pairs")[at].as_py()})
            spans = [(-(-least * s // parts), most * s // parts) for s in scores]
            for score, held in zip(scores, group.best(q, top, bottom, negatives, spans, group.labels != own)):
                for s, other in held:
                    yield anchor, score, -other, s

    hits = _searched(candidates, windows, groups, blocks, far, "anchor long, positive_score long, negative long, score long")
    rank = F.row_number().over(W.partitionBy("anchor", "positive_score").orderBy(F.col("score").desc(), "negative"))
    hits = hits.withColumn("rank", rank).where(F.col("rank") <= negatives)
    out = pairs.select(F.col("anchor"), F.col("positive").alias("positive_id"), F.col("score").alias("positive_score")).join(hits, ["anchor", "positive_score"])
    return out.select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("negative").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
