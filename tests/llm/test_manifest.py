"""Merkle trees against plain ones."""

import random
import zlib
from collections import Counter
from hashlib import sha256

from llm.odd import TEXTS, documents, empty
from pyspark.sql import functions as F

from banterscope.llm import manifest, queries
from banterscope.llm.samples import fold

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g long, pos long, leaf string, left int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The root, and for each node the siblings on the way, with whether they stand to the left."""
    ways = [[] for _ in nodes]
    spots = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(spots):
            other = at ^ 1
            ways[k].append((other < at, nodes[other]) if other < len(nodes) else None)
            spots[k] = at // 2
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], ways


def follow(node, way):
    for step in way:
        node = h(node) if step is None else h(step[1], node) if step[0] else h(node, step[1])
    return node


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {}
    for name in names:
        ordered = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        own[name] = (ordered, *climb([leaf(r) for r in ordered]))
    root, above = climb([own[name][1] for name in names])
    out = []
    for name, upper in zip(names, above):
        ordered, subroot, ways = own[name]
        for row, way in zip(ordered, ways):
            found = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                found = leaf((*row[:3], row[3] + 1, row[4]))
            end = follow(found, way + upper)
            proof = h(*(s[1] for s in way + upper if s))
            out.append((row[0], leaf(row), subroot, root, proof, end, end == root))
    return Counter(out)


def run(frame):
    found = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    return manifest.manifest(frame, "doc_id", "lang", [F.col(c) for c in FIELDS], fold("doc_id", 7) == 0, found)


def check(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2, "own", 3) for r in rows], SCHEMA).repartition(5)
    assert Counter(tuple(r) for r in run(frame).collect()) == plain(rows)


def test_trees_of_several_arrays(spark):
    r = random.Random(6)
    spread = [r.randrange(-(1 << 62), 1 << 62) for _ in range(300)] + list(range(700))
    check(spark, [(i, "s", "big", 3, f"text {i}") for i in spread] + [(i, None, r.choice(["é", "z", None, "a"]), None, "x") for i in range(60)])


def test_repeated_and_missing_keys(spark):
    rows = [(5, "s", "a", 1, "same")] * 300 + [(5, "s", "a", 1, f"other {i}") for i in range(40)] + [(None, "s", "a", i, "t") for i in range(50)]
    rows += [(None, None, "a", None, None)] * 4 + [(4, "s", "a", 1, ""), (6, "s", "a", 1, "x"), (-1, "s", None, 1, "x"), (70, "s", "a", 0, "x")]
    check(spark, rows)


def test_odd_rows(spark):
    got = run(documents(spark)).collect()
    assert Counter((r.doc_id, r.leaf) for r in got) == Counter((i, leaf((i, "s", "en", len(t or ""), t))) for i, t in TEXTS)
    assert len({r.root for r in got}) == 1
    assert run(empty(spark)).count() == 0
    one = run(documents(spark, [(3, "x")])).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == h("")


def test_tampered_rows_are_found(spark, tables):
    rows = queries.op11_manifest(spark, tables).collect()
    docs = [tuple(r[c] for c in FIELDS) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in rows) == plain(docs)
    assert {r.verified for r in rows} == {True, False}


def test_ranks(spark):
    r = random.Random(1)
    rows = [(g, k, r.randrange(1, 4)) for g in range(3) for k in {r.randrange(-500, 500) for _ in range(200)} | {r.randrange(-(1 << 63), 1 << 63) for _ in range(50)}]
    got = manifest.ranked(spark.createDataFrame(rows, "g long, k long, n long"), ["g"], "k", "n", "before").collect()
    assert all(x.before == sum(n for g, k, n in rows if g == x.g and k < x.k) and x._same == x.n for x in got) and len(got) == len(rows)
