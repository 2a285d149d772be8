"""Hard negatives against brute force."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from banterscope.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, anchor string, cell string, score string"


def plain(rows, every, positives=5, count=5):
    own = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in v]
        if i not in own or (label, v) < own[i]:
            own[i] = (label, v)
    out = []
    for a, (label, v) in own.items():
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in own.items() if i != a]
        for p, i, same in sorted(s for s in scored if s[2])[:positives]:
            hits = sorted((n, k) for n, k, s in scored if not s and 80 * -p <= 100 * -n <= 100 * -p)
            out += [(a, i, r + 1, k, -p, -n) for r, (n, k) in enumerate(hits[:count])]
    return Counter(out)


def check(spark, rows, every=3, **more):
    frame = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(4)
    got = negatives.hard_negatives(frame, anchors=F.col("vec_id") % every == 0, **more)
    assert Counter(tuple(r) for r in got.collect()) == plain(rows, every, more.get("positives", 5), more.get("negatives", 5))


def vectors(n, dims, r, clusters=8, spread=0.15):
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    return [[x + r.gauss(0, spread) for x in r.choice(centres)] for _ in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, v, r.randrange(3)) for i, v in enumerate(vectors(400, 6, r))]
    check(spark, rows)
    monkeypatch.setattr(negatives, "FEWEST_ROWS", 40)
    monkeypatch.setattr(negatives, "BLOCK", 50)
    monkeypatch.setattr(negatives, "LEAF", 4)
    check(spark, rows)


def test_ties_copies_and_odd_rows(spark):
    r = random.Random(3)
    rows = [(i, [1.0, 0.5], i % 2) for i in range(60)] + [(100 + i, [float(r.randrange(-2, 3)), 0.0], i % 3) for i in range(60)]
    rows += rows[:20] + [(5, [9.0, 9.0], 1), (None, [1.0, 1.0], 1), (300, None, 1), (303, [1.0, 1.0], None), (306, [1.0, None], 0), (309, [math.nan, 1.0], 0), (312, [math.inf, 1.0], 1)]
    rows += [(315, [], 0), (318, [3.0], 0), (321, [1.0, 1.0, 1.0, 1.0], 1), (324, [-1.0, -2.0], 0), (327, [0.0, 0.0], 1)]
    check(spark, rows, positives=7, negatives=3)
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(3, [1.0], 0)])


def test_scores_beyond_doubles_are_exact(spark):
    r = random.Random(4)
    check(spark, [(i, [r.uniform(-3e5, 3e5) for _ in range(5)], r.randrange(2)) for i in range(60)])
    huge = spark.createDataFrame([(i, [3e38, 1.0], i % 2, *"abcd") for i in range(6)], SCHEMA)
    assert {x.negative_score for x in negatives.hard_negatives(huge).collect()} == {(1 << 63) - 1}


def test_bounds_hold_and_skip(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 64)
    r = random.Random(5)
    own = np.floor(256 * np.array(vectors(3000, 8, r, clusters=40, spread=0.05)))
    group = negatives.Group(np.arange(3000), np.zeros(3000, np.int64), own)
    tree, read = group.tree, []
    asks = own[:20] * 0.9 // 1
    tops, bottoms = group.bounds(asks)
    for (start, stop), top, bottom in zip(tree.span, tops.T, bottoms.T):
        scores = group.vectors[start:stop] @ asks.T
        assert (scores <= top).all() and (scores >= bottom).all()
    plainly = group.scores
    group.scores = lambda rows, q: read.append(rows.stop - rows.start) or plainly(rows, q)
    for q, top, bottom in zip(asks, tops, bottoms):
        found = group.best(q, top, bottom, 5, [(-math.inf, math.inf)], np.ones(3000, bool))[0]
        assert sorted((s for s, _ in found), reverse=True) == sorted(plainly(slice(0, 3000), q).astype(int).tolist(), reverse=True)[:5]
    assert sum(read) < 20 * 3000 / 2  # most nodes are never opened


def test_levels_cover_and_stay_apart():
    r = random.Random(6)
    tree = negatives.CoverTree(np.floor(256 * np.array(vectors(2000, 5, r))))
    for node, (first, last) in enumerate(tree.children):
        start, stop = tree.span[node]
        far = np.linalg.norm(tree.augmented[start:stop] - tree.points[node], axis=1)
        assert far.max() <= tree.radius[node] + 1e-6
        if first < last:
            centres = tree.points[first:last]
            apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)[~np.eye(last - first, dtype=bool)]
            assert apart.min(initial=np.inf) >= tree.radius[node] * negatives.SHRINK * 0.999
            assert max(tree.radius[first:last]) <= tree.radius[node] * negatives.SHRINK * 1.001


def test_rows_of_the_given_table(spark, tables):
    from banterscope.llm.queries import op13_negatives

    rows = [(x.vec_id, x.embedding, (x.label + 1) % 10 if x.vec_id % 7 == 0 else x.label) for x in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    assert Counter(tuple(x) for x in op13_negatives(spark, tables).collect()) == plain(rows, 100)
