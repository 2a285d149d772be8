"""Join of texts by the Jaccard similarity of their word shingles, with signature trees.

A text's set holds the hashes of its runs of ``width`` words (white space apart, A-Z lower-cased). Two texts are
linked if ``parts * |A & B| >= share * |A | B|``. The result is exact up to collisions of 64-bit hashes within a
pair; no link between different sets is lost.

1. Texts with the same set are one leaf. A leaf shows the tokens that any partner must share one of: under a
   fixed order, the first ``n - ceil(n * share / parts) + 1`` of its ``n`` tokens. The order goes by how many texts
   have a token, all texts counted, so that passages which texts share come last.
2. Leaves that show the same token, or have it among their few least hashes, meet its least leaf in their size band
   and in the next ones only, never each other. The key of a leaf begins with its size band and then with how common
   its tokens are, so the least is the one most like the text that a group was copied from: any other copy differs
   from a member by its own changes too. Pairs that hold make the lower nodes of the tree: groups of leaves that
   are linked already, so large groups of near copies are dealt with by a few pairs a member.
3. Nodes keep the range of sizes, and the OR and the AND of the leaves' token bitmaps. Pairs of different nodes
   that show a common token are followed from node to leaf on both sides: node with node, leaf with node, leaf
   with leaf. What all leaves of one side have and no leaf of the other can't be common, and a pair is dropped as
   soon as sizes and bitmaps bound the overlap below what a link needs. What is left is verified on the whole sets.
4. Components of all links are found by rounds over tables.

Cases: null and empty texts and texts without words have an empty set and are linked with nothing. A text of
fewer words has its whole sequence as its only token. Repeated rows and null keys are kept: each row comes out
once; a component's id is the least non-null key in it.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banterscope.llm.blocks import BitFilter, WordTable, kept, make_room, mix, shingles, sized_filter, text_blocks
from banterscope.llm.components import components
from banterscope.session import discard, materialise

# Texts are counted by slots of tokens, in chunks of slots; so many tasks' chunks are added up at a time. The order
# that comes of it changes the work only, never the result.
SLOTS_LOG = 24
CHUNK_LOG = 15
ADDED = 256
LEAST_BITS_LOG = 10
# Tokens of the least hashes by which near copies find each other first.
LEAST = 3
# Each size band ends at this many times its least size, or more: one byte holds the bands of all sizes.
LEAST_BAND = 1.1
# Bytes at the end of a leaf's key that tell its set.
DIGEST = 13
# Leaves that a node has on average; more would fill its bitmap.
NODE_LEAVES = 16


def token_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    table = kept("spaced words", WordTable.spaced)
    hashes, _, _, firsts, _ = table.words(texts)
    values, starts = shingles(hashes, firsts, width)
    for i in range(len(texts)):
        yield np.unique(values[starts[i] : starts[i + 1]])


def set_digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=DIGEST).digest()


def set_key(tokens: np.ndarray, codes: np.ndarray, share: int, parts: int) -> bytes | None:
    """The leaf of a set: a byte of its size band, two that are less the more texts have its tokens, and a digest.

    Sets that may be linked are in the same band or in neighbouring ones.
    """
    if not len(tokens):
        return None
    band = min(255, int(math.log(len(tokens)) / math.log(max(parts / share, LEAST_BAND))))
    common = int(256 * codes[_slot(tokens)].mean())
    return bytes([band]) + (65535 - common).to_bytes(2, "big") + set_digest(tokens)


def bitmap(tokens: np.ndarray) -> bytes:
    """One bit for each token, in the power of two of bits that is at least twice their number, and 1,024 at least:
    a link of small sets hangs on a few tokens, which must not fall on one bit."""
    size = 1 << max(LEAST_BITS_LOG, (2 * len(tokens) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(mix(tokens) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap with ``size`` bytes: the halves of a longer one are combined by OR."""
    out = np.frombuffer(bits, np.uint8)
    return out if len(out) == size else np.bitwise_or.reduce(out.reshape(-1, size), 0)


def outside(a: bytes, b: bytes) -> tuple[int, int]:
    """How many tokens of the first set, at least, the second lacks, and the other way round."""
    size = min(len(a), len(b))
    x, y = folded(a, size), folded(b, size)
    return int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum())


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64((1 << SLOTS_LOG) - 1)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """A chunk of counts: a bit for each slot that has some, then these counts' low bytes and their high bytes."""
    some = counts[counts > 0]
    planes = some.astype("<u2").view(np.uint8).reshape(-1, 2).T
    return zlib.compress(np.packbits(counts > 0).tobytes() + planes.tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    data = np.frombuffer(zlib.decompress(raw), np.uint8)
    bits = 1 << (CHUNK_LOG - 3)
    low, high = data[bits:].reshape(2, -1).astype(np.uint16)
    counts = np.zeros(1 << CHUNK_LOG, np.uint16)
    counts[np.unpackbits(data[:bits]).astype(bool)] = low | high << np.uint16(8)
    return counts


def _added(chunks: pa.Table) -> np.ndarray:
    total = np.zeros(1 << CHUNK_LOG, np.int64)
    for raw in chunks.column("texts").to_pylist():
        total += _unpacked(raw)
    return np.minimum(total, 65535).astype(np.uint16)


def _coded(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: up to 127 as they are, beyond that in eighths of a doubling."""
    beyond = 128 + 8 * np.log2(np.maximum(counts, 128) / 128)
    return np.where(counts < 128, counts, beyond).astype(np.uint8)


def slot_counts(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """How many texts have a token in each slot, as codes: every task counts all its texts, and the counts are added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        slots = np.zeros(1 << SLOTS_LOG, np.uint16)
        for batch in batches:
            for _, texts in text_blocks(batch, text):
                for tokens in token_sets(texts, width):
                    at = np.unique(_slot(tokens))
                    slots[at] += slots[at] < 65535
        rows = slots.reshape(-1, 1 << CHUNK_LOG)
        some = np.flatnonzero(rows.any(1))
        part = TaskContext.get().partitionId() // ADDED
        for start in range(0, len(some), 32):
            own = some[start : start + 32]
            packed = [_packed(rows[c]) for c in own.tolist()]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(own, pa.int64()), "part": pa.array([part] * len(own), pa.int64()), "texts": packed})

    def add(key: tuple, chunks: pa.Table) -> pa.Table:
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "texts": [_packed(_added(chunks))]})

    def code(key: tuple, chunks: pa.Table) -> pa.Table:
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "codes": [_coded(_added(chunks)).tobytes()]})

    counted = docs.select(text).mapInArrow(count, "chunk long, part long, texts binary")
    added = counted.groupBy("chunk", "part").applyInArrow(add, "chunk long, texts binary")
    codes = np.zeros((1 << (SLOTS_LOG - CHUNK_LOG), 1 << CHUNK_LOG), np.uint8)
    coded = materialise(added.groupBy("chunk").applyInArrow(code, "chunk long, codes binary"), "slots")
    for chunk, raw in coded.toLocalIterator():
        codes[chunk] = np.frombuffer(raw, np.uint8)
    discard(coded)
    return codes.reshape(-1)


def shown(tokens: np.ndarray, codes: np.ndarray, share: int, parts: int) -> np.ndarray:
    """The tokens of a set of which any linked set has at least one: rare ones first, then by hash."""
    n = len(tokens)
    count = n - -(-n * share // parts) + 1
    return tokens[np.lexsort((tokens, codes[_slot(tokens)]))[:count]]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(parts).view(np.int64))


def _leaves(docs: DataFrame, key: str, text: str, width: int, share: int, parts: int) -> DataFrame:
    """``key, n, leaf, tag, bits, least, shown`` of every row; ``tag`` finds the text again."""
    kind = docs.schema[key].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(slot_counts(docs, text, width).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        codes = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            for rows, texts in text_blocks(batch, "text"):
                sets = list(token_sets(texts, width))
                lists = [shown(t, codes, share, parts) if len(t) else t for t in sets]
                columns = [
                    rows.column("key"),
                    pa.array([len(t) for t in sets], pa.int64()),
                    pa.array([set_key(t, codes, share, parts) for t in sets], pa.binary()),
                    rows.column("tag"),
                    pa.array([bitmap(t) if len(t) else None for t in sets], pa.binary()),
                    _lists([t[:LEAST] for t in sets]),
                    _lists(lists),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n", "leaf", "tag", "bits", "least", "shown"])

    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tag"))
    return materialise(plain.mapInArrow(run, f"key {kind}, n long, leaf binary, tag long, bits binary, least array<long>, shown array<long>"), "leaves")


def _sets(docs: DataFrame, text: str, width: int, wanted: BitFilter) -> DataFrame:
    """``digest, tokens`` of the texts whose tags are wanted (and a few others)."""
    held = docs.sparkSession.sparkContext.broadcast(wanted.bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        own = BitFilter(held.value)
        for batch in batches:
            batch = batch.filter(pa.array(own.has(batch.column("tag").to_numpy().view(np.uint64))))
            for _, texts in text_blocks(batch, "text"):
                sets = [t for t in token_sets(texts, width) if len(t)]
                columns = [pa.array([set_digest(t) for t in sets], pa.binary()), pa.array([t.tobytes() for t in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "tokens"])

    found = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("tag")).mapInArrow(run, "digest binary, tokens binary")
    # Equal sets have equal rows, so any one will do.
    return found.groupBy("digest").agg(F.any_value("tokens").alias("tokens"))


def _bounded(pairs: DataFrame, left: str, right: str, share: int, parts: int) -> DataFrame:
    """Pairs whose sizes and bitmaps leave room for a link.

    A side may be a node: ``n`` is then its least size, and its bitmap the OR of its leaves'. Only a leaf on the
    left can be held against a node on the right.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            x, y, n, m = (batch.column(c).to_pylist() for c in ("bits_" + left, "bits_" + right, "n_" + left, "n_" + right))
            for p, q, i, j in zip(x, y, n, m, strict=True):
                lacks, other = outside(p, q)
                most = i - lacks if right.startswith("node") else min(i - lacks, j - other)
                good.append(most * (parts + share) >= (i + j) * share)
            yield batch.filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, pairs.schema)


def _verified(pairs: DataFrame, leaves: DataFrame, docs: DataFrame, text: str, width: int, share: int, parts: int) -> DataFrame:
    """The pairs ``a, b`` of leaves that are linked, by their whole sets."""
    pairs = materialise(pairs.select("a", "b").distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("leaf")).union(pairs.select("b")).distinct()
    tags = materialise(ends.join(leaves.select("leaf", "tag"), "leaf").groupBy("leaf").agg(F.min("tag").alias("tag")), "tags")
    sets = materialise(_sets(docs, text, width, sized_filter(tags.select("tag"))), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            good = []
            for x, y in zip(batch.column("one"), batch.column("two"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(parts * both >= share * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = sets.select(F.col("digest").alias("_a"), F.col("tokens").alias("one"))
    two = sets.select(F.col("digest").alias("_b"), F.col("tokens").alias("two"))
    told = lambda leaf: F.substring(leaf, -DIGEST, DIGEST)
    joined = pairs.join(one, told("a") == F.col("_a")).join(two, told("b") == F.col("_b")).select("a", "b", "one", "two")
    verified = materialise(joined.mapInArrow(run, "a binary, b binary"), "verified")
    discard(pairs, tags, sets)
    return verified


def _fits(x: Column, y: Column, share: int, parts: int) -> Column:
    """Whether sizes alone allow a link: the smaller set is large enough."""
    return (F.least(x, y) * parts >= F.greatest(x, y) * share)


def _reaches(overlap: Column, x: Column, y: Column, share: int, parts: int) -> Column:
    """Whether an overlap of at most this allows a link between sets of (at least) these sizes."""
    return overlap * (parts + share) >= (x + y) * share


def _with_words(frame: DataFrame, **bitmaps: str) -> DataFrame:
    """``frame`` with its bitmaps, folded to the least size, as numbers that joins can compare: each new column by its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[folded(b, 1 << (LEAST_BITS_LOG - 3)).view(np.int64) for b in batch.column(c).to_pylist()] for c in bitmaps.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.list_(pa.int64())) for x in own)], [*batch.schema.names, *bitmaps])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields]
    return frame.mapInArrow(run, ", ".join([*fields, *(f"{c} array<long>" for c in bitmaps)]))


def _lacks(x: str, y: str) -> Column:
    """How many tokens, at least, the first folded bitmap has and the second hasn't."""
    missing = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))).cast("long"))
    return F.aggregate(missing, F.lit(0).cast("long"), lambda total, n: total + n)


def _words_fit(share: int, parts: int) -> Column:
    """Whether the folded bitmaps of two leaves ``a, b`` leave room for a link."""
    most = F.least(F.col("n_a") - _lacks("words_a", "words_b"), F.col("n_b") - _lacks("words_b", "words_a"))
    return _reaches(most, F.col("n_a"), F.col("n_b"), share, parts)


def _nodes(tree: DataFrame) -> DataFrame:
    """``root, node, low, high, any, all`` of every node: its range of sizes, the OR and the AND of its leaves' bitmaps.

    A node has a few leaves; their bitmaps are folded to the shortest one.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            either, every = [], []
            for bits in batch.column("bits").to_pylist():
                own = [folded(b, min(map(len, bits))) for b in bits]
                either.append(np.bitwise_or.reduce(own).tobytes())
                every.append(np.bitwise_and.reduce(own).tobytes())
            columns = [*(batch.column(c) for c in ("root", "node", "low", "high")), pa.array(either, pa.binary()), pa.array(every, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["root", "node", "low", "high", "any", "all"])

    grouped = tree.groupBy("root", "node").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.collect_list("bits").alias("bits"))
    return grouped.mapInArrow(combine, "root binary, node int, low long, high long, any binary, all binary")


def _near(pairs: DataFrame, nodes: DataFrame, share: int, parts: int) -> DataFrame:
    """Pairs of nodes of which some two leaves may be linked.

    What all leaves of a node have and no leaf of the other has is missing in each overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for r in batch.select(["any1", "all1", "any2", "all2", "low1", "high1", "low2", "high2"]).to_pylist():
                most = min(r["high1"] - outside(r["all1"], r["any2"])[0], r["high2"] - outside(r["all2"], r["any1"])[0])
                good.append(most * (parts + share) >= (r["low1"] + r["low2"]) * share)
            yield batch.select(["root1", "node1", "root2", "node2"]).filter(pa.array(good, pa.bool_()))

    nodes = nodes.drop("some", "every")
    for i in "12":
        pairs = pairs.join(nodes.select(*(F.col(c).alias(c + i) for c in nodes.columns)), ["root" + i, "node" + i])
    return pairs.mapInArrow(run, "root1 binary, node1 int, root2 binary, node2 int")


def _classes(inner: DataFrame) -> DataFrame:
    """``class, root, node, size, low, high, rest``: the nodes that show a token, once for all tokens that the same nodes show.

    A class is a sum over its nodes. Should two fall on one, their nodes meet more often than needed, nothing is lost.
    ``rest``: how many tokens a leaf of the node has from its first token of the class on, at most.
    """
    top = inner.groupBy("token", "root", "node").agg(F.any_value("size").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("at")).alias("rest"))
    places = top.groupBy("token").agg(F.xxhash64(F.bit_xor(F.xxhash64("root", "node")), F.count("*")).alias("class"))
    return top.join(places, "token").groupBy("class", "root", "node").agg(F.any_value("size").alias("size"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("rest").alias("rest"))


def _stars(shows: DataFrame) -> DataFrame:
    """``a, b``: every leaf with the least leaf of its own and of the neighbouring size bands that has one of its tokens."""
    band = lambda leaf: F.conv(F.hex(F.substring(leaf, 1, 1)), 16, 10).cast("int")
    least = shows.groupBy("token", F.substring("leaf", 1, 1)).agg(F.min("leaf").alias("b")).select("token", "b")
    near = F.abs(band("leaf") - band("b")) <= 1
    return shows.join(least, "token").where(near & F.expr("leaf <> b")).select(F.col("leaf").alias("a"), "b")


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, share: int = 85, parts: int = 100) -> DataFrame:
    """``key, n_shingles, component_id`` of every row of ``docs``."""
    leaves = _leaves(docs, key, text, width, share, parts)
    seen = leaves.where("leaf is not null").select(F.posexplode("shown").alias("at", "token"), "leaf")
    # Tokens that more than one leaf shows. Partial sums make a hot token one row a task.
    short = F.xxhash64("leaf")
    meeting = seen.groupBy("token").agg(F.min(short).alias("_least"), F.max(short).alias("_most")).where("_least <> _most")
    meeting = materialise(meeting.select("token"), "tokens")
    held = docs.sparkSession.sparkContext.broadcast(sized_filter(meeting).bits.tobytes())

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BitFilter(held.value)
        for batch in batches:
            yield batch.filter(pa.array(own.has(batch.column("token").to_numpy().view(np.uint64))))

    shows = materialise(seen.mapInArrow(narrow, seen.schema).join(meeting, "token").distinct(), "shows")
    discard(meeting)
    near = leaves.where("leaf is not null").select(F.explode("least").alias("token"), "leaf").distinct()
    # Every leaf with the least leaves, by bands, of each token that it shows or has among its least hashes.
    stars = _stars(shows.select("token", "leaf")).union(_stars(near)).distinct()
    stars = materialise(stars, "stars")
    met = shows.select("leaf").union(stars.select("a")).union(stars.select("b")).distinct()
    known = leaves.join(met, "leaf").groupBy("leaf").agg(F.any_value("n").alias("n"), F.any_value("bits").alias("bits"))
    known = materialise(known, "known")
    # Bitmaps and lists of tokens are by far the larger part of the leaves, and have been used.
    wide, leaves = leaves, materialise(leaves.select("key", "n", "leaf", "tag"), "named")
    discard(wide)

    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(F.col("leaf").alias(name), F.col("n").alias("n_" + name), F.col("bits").alias("bits_" + name))

    bound = stars.join(side(known, "a"), "a").join(side(known, "b"), "b").where(_fits(F.col("n_a"), F.col("n_b"), share, parts))
    links = _verified(_bounded(bound, "a", "b", share, parts), leaves, docs, text, width, share, parts)
    discard(stars)
    nodes = components(links)
    # Third step: what leaves of different components can still have in common. A node has some leaves of one.
    member = known.select("leaf", "n").join(nodes.withColumnRenamed("node", "leaf"), "leaf", "left")
    member = member.select("leaf", "n", F.coalesce("root", "leaf").alias("root"))
    counts = member.groupBy("root").agg(F.count("*").alias("size"), F.ceil(F.count("*") / NODE_LEAVES).alias("_nodes"))
    member = member.join(counts, "root").withColumn("node", F.pmod(F.xxhash64("leaf"), F.col("_nodes")).cast("int")).drop("_nodes")
    inner = shows.join(member, "leaf")
    apart = inner.groupBy("token").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least <> _most").select("token")
    inner = materialise(inner.join(apart, "token"), "inner")
    discard(shows)
    tree = inner.select("leaf", "root", "node", "n").distinct().join(known.select("leaf", "bits"), "leaf")
    tree = materialise(_with_words(tree, words="bits"), "tree")
    discard(known)
    ranges = materialise(_with_words(_nodes(tree), some="any", every="all"), "nodes")
    top = _classes(inner).join(ranges.select("root", "node", "some", "every"), ["root", "node"])
    one, two = (top.select("class", *(F.col(c).alias(c + i) for c in ("root", "node", "size", "low", "high", "rest", "some", "every"))) for i in "12")
    # The node of the smaller component is the first, whose leaves are taken one by one.
    pairs = one.join(two, "class").where("size1 < size2 or (size1 = size2 and root1 < root2)")
    pairs = pairs.where((F.col("high1") * parts >= F.col("low2") * share) & (F.col("high2") * parts >= F.col("low1") * share))
    # At their first common token, what two sets have before it is not common.
    pairs = pairs.where(_reaches(F.least("rest1", "rest2"), F.col("low1"), F.col("low2"), share, parts))
    most = F.least(F.col("high1") - _lacks("every1", "some2"), F.col("high2") - _lacks("every2", "some1"))
    pairs = pairs.where(_reaches(most, F.col("low1"), F.col("low2"), share, parts))
    pairs = pairs.select("root1", "node1", "root2", "node2").distinct()
    pairs = _near(pairs, ranges, share, parts)
    # A leaf of the first node against the second node, then against that node's leaves.
    first = tree.select(F.col("root").alias("root1"), F.col("node").alias("node1"), F.col("leaf").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"), F.col("words").alias("words_a"))
    second = ranges.select(F.col("root").alias("root2"), F.col("node").alias("node2"), F.col("low").alias("n_node"), F.col("high").alias("_high"), F.col("any").alias("bits_node"))
    against = pairs.join(first, ["root1", "node1"]).join(second, ["root2", "node2"])
    against = against.where((F.col("n_a") * parts >= F.col("n_node") * share) & (F.col("_high") * parts >= F.col("n_a") * share))
    against = _bounded(against, "a", "node", share, parts).select("root2", "node2", "a", "n_a", "bits_a", "words_a").distinct()
    last = tree.select(F.col("root").alias("root2"), F.col("node").alias("node2"), F.col("leaf").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"), F.col("words").alias("words_b"))
    ends = against.join(last, ["root2", "node2"]).where(_fits(F.col("n_a"), F.col("n_b"), share, parts) & _words_fit(share, parts)).drop("words_a", "words_b")
    more = _verified(_bounded(ends, "a", "b", share, parts), leaves, docs, text, width, share, parts)
    discard(inner, tree, ranges)
    if not more.isEmpty():
        # Leaves are linked already within their nodes; the new links join nodes.
        nodes = components(nodes.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    rows = leaves.select("key", "n", "leaf").join(nodes.withColumnRenamed("node", "leaf"), "leaf", "left")
    rows = rows.select("key", "n", F.coalesce("root", "leaf").alias("root"))
    least = rows.where("root is not null").groupBy("root").agg(F.min("key").alias("_least"))
    out = rows.join(least, "root", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("_least", "key").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, share: int = 80, parts: int = 100) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the one with the least key stays, unchanged.

    Texts without words are no copies and stay. So do rows without a key, which can't be named, and all rows that
    repeat a key that stays: they are the same document.
    """
    found = linked(docs, key, text, width, share, parts).where(F.col(key) == F.col("component_id")).select(F.col(key).alias("_key")).distinct()
    return docs.where(F.col(key).isNull()).unionAll(docs.join(found, docs[key] == found["_key"], "left_semi"))
