"""Joins, containment and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from llm.odd import TEXTS, documents, empty, malformed
from pyspark.sql import functions as F

from banterscope.llm import fingerprints, jaccard, leaks
from banterscope.llm.components import components
from banterscope.session import materialise


def sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute(rows, width, share, parts):
    own = [(i, sets(t, width)) for i, t in rows]
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            x, y = own[a][1], own[b][1]
            if x and y and parts * len(x & y) >= share * len(x | y):
                root[find(a)] = find(b)
    group = {}
    for k, (i, _) in enumerate(own):
        group.setdefault(find(k), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in group.items()}
    return Counter((i, len(s), least[find(k)]) for k, (i, s) in enumerate(own))


def planted():
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    common = " ".join(r.choice(words) for _ in range(60))
    rows = []
    for g in range(12):
        base = [r.choice(words) for _ in range(r.choice([3, 4, 5, 20, 60, 200]))]
        for _ in range(r.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((100 + len(rows), " ".join(copy)))
        rows.append((100 + len(rows), common + " " + " ".join(r.choice(words) for _ in range(40))))
    chain = [r.choice(words) for _ in range(80)]
    for _ in range(8):  # a chain whose ends are not alike
        chain[r.randrange(80)] = r.choice(words)
        rows.append((100 + len(rows), " ".join(chain)))
    return rows


def got(frame):
    return Counter((r[0], r[1], r[2]) for r in frame.collect())


def test_join_equals_brute_force(spark):
    rows = planted()
    assert got(jaccard.linked(documents(spark, rows).repartition(5))) == brute(rows, 4, 85, 100)
    assert got(jaccard.linked(documents(spark, rows), width=5, share=80)) == brute(rows, 5, 80, 100)


def test_join_takes_odd_rows(spark):
    assert got(jaccard.linked(documents(spark))) == brute(TEXTS, 4, 85, 100)
    assert jaccard.linked(empty(spark)).count() == 0
    one = jaccard.one_of_each(documents(spark))
    assert one.columns == documents(spark).columns
    assert sorted(r.doc_id or 0 for r in one.collect()) == [0, 0, 1, 2, 3, 4, 5, 5, 7, 8]


def group(copies, quotes):
    """Copies of a text, which isn't there itself, with two words changed each, and short texts of a passage that they share."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for start in range(0, 150, 50) if quotes else ():
        rows += [(len(rows) + k, " ".join(base[start : start + 50] + [f"q{start}{k}"] * (k > 0))) for k in range(quotes)]
    for _ in range(copies):
        copy = list(base)
        for _ in range(2):
            copy[r.randrange(150)] = f"e{r.randrange(10**9)}"
        rows.append((1000 + len(rows), " ".join(copy)))
    return rows


def test_large_groups_of_near_copies_take_a_few_pairs_a_member(spark, monkeypatch):
    made = Counter()

    def written(frame, name):
        out = materialise(frame, name)
        made[name] += out.count()
        return out

    monkeypatch.setattr(jaccard, "materialise", written)
    for copies, quotes in ((600, 0), (600, 20)):
        made.clear()
        rows = group(copies, quotes)
        assert got(jaccard.linked(documents(spark, rows), width=5, share=80)) == brute(rows, 5, 80, 100)
        assert made["pairs"] <= 4 * len(rows) and made["verified"] <= 4 * len(rows)


def test_leaves_begin_with_their_size_band_and_common_tokens():
    codes = np.zeros(1 << jaccard.SLOTS_LOG, np.uint8)
    tokens = np.arange(3000, dtype=np.uint64)
    codes[:500] = 200
    for share, parts in ((85, 100), (80, 100), (1, 1), (1, 2)):
        key = lambda x: jaccard.set_key(x, codes, share, parts)
        assert all(abs(key(tokens[:n])[0] - key(tokens[: -(-n * share // parts)])[0]) <= 1 for n in range(1, 3000))
        assert key(tokens[:500]) < key(tokens[1:501]) < key(tokens[2:502]) and key(tokens[:0]) is None


def test_bitmaps_bound_from_below():
    r = np.random.default_rng(1)
    for _ in range(50):
        x, y = (np.unique(r.integers(0, 400, r.integers(1, 300))).astype(np.uint64) for _ in range(2))
        a, b = jaccard.outside(jaccard.bitmap(x), jaccard.bitmap(y))
        assert a <= len(set(x) - set(y)) and b <= len(set(y) - set(x))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 50), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in components(links).collect()}
    assert roots == {**{i: 0 for i in range(21)}, 40: 40, 50: 40}


def test_benchmark_items(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "only three words"), (3, None), (4, ""), (5, "UP down, left right front back inside outside")]
    text = "alpha BETA gamma; delta epsilon zeta eta theta iota kappa"
    rows = [(10, f"before {text} after"), (11, "only three words here"), (12, "alpha beta gamma delta epsilon"), (13, None), (14, ""), (None, text), (15, f"x {text}"), (15, f"x {text}"), (16, "up down left right front back inside else")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = leaks.contained(documents(spark, rows), bench)
    assert sorted((r[0] or 0, r.item_id, r.shared, r.n_item) for r in found.collect()) == [(0, 1, 6, 6), (10, 1, 6, 6), (11, 2, 1, 1), (15, 1, 6, 6)]
    kept = leaks.without_items(documents(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [12, 13, 14, 16]
    assert kept.columns == documents(spark).columns
    assert leaks.contained(empty(spark), bench).count() == 0
    assert leaks.without_items(documents(spark), bench.limit(0)).count() == len(TEXTS)


def weighted(a, b):
    x, y = (Counter(w.lower() for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", t)) for t in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_samples_agree_as_often_as_the_weighted_sets_are_alike():
    r = random.Random(9)
    own = fingerprints.sampler()
    errors = []
    for _ in range(60):
        a = [f"v{r.randrange(40)}" for _ in range(120)]
        b = a[: r.randrange(120)] + [f"v{r.randrange(80)}" for _ in range(60)]
        a, b = " ".join(a), " ".join(b)
        x, y = own.fingerprints([a.encode(), b.encode()])
        errors.append(fingerprints.likeness(x, y) - weighted(a, b))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def test_next_texts_follow_the_order_of_keys(spark):
    rows = [(i, f"text number {i} " + "word " * (i % 7)) for i in range(0, 300, 3)]
    got = {r.doc_id: r for r in fingerprints.compare_with_next(documents(spark, rows).repartition(7)).collect()}
    own = fingerprints.sampler()
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        prints = own.fingerprints([text.encode(), changed.encode(), following.encode()])
        assert got[i].near_edited == (prints[0] == prints[1]).mean() and got[i].near_next == (prints[0] == prints[2]).mean()


def test_fingerprints_take_odd_rows(spark):
    rows = fingerprints.compare_with_next(documents(spark)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in TEXTS)
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 6)}) == 1
    assert {r.fingerprint for r in rows if r.doc_id in (2, 3, 4)} == {"0" * 8 * fingerprints.SAMPLES}
    assert fingerprints.compare_with_next(empty(spark)).count() == 0
    assert fingerprints.fingerprint(documents(spark)).select(F.count("*")).first()[0] == len(TEXTS)


def test_counts_by_slots_come_back():
    rng = np.random.default_rng(3)
    for counts in (np.zeros(1 << jaccard.CHUNK_LOG), np.full(1 << jaccard.CHUNK_LOG, 65535), rng.poisson(0.2, 1 << jaccard.CHUNK_LOG) * rng.integers(1, 900)):
        counts = counts.astype(np.uint16)
        assert (jaccard._unpacked(jaccard._packed(counts)) == counts).all()


def test_bytes_that_are_no_text_have_the_fingerprint_of_their_marks(spark):
    given, plain = malformed(spark)
    for run in (fingerprints.fingerprint, fingerprints.compare_with_next):
        found, wanted = (sorted(map(repr, run(docs).collect())) for docs in (given, plain))
        assert found == wanted
