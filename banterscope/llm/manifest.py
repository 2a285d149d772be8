"""A Merkle manifest of a dataset: digests of rows, of groups and of the whole, and a proof for every row.

A row's leaf is the digest of its fields. In each group the leaves stand in the order of the key; while a group
has several nodes, each two neighbours become one (a last one alone becomes the digest of itself). What remains is
the group's root. The roots of the groups, ordered by the group's name, are joined in the same way.

1. Where a leaf stands is found without sorting. Keys are bits of 64-bit words, OR-ed together by tasks first and
   then by group; only words that hold a key exist. Directories count the keys before each word, and before each
   run of 2^16 words, runs of runs and so on, so that no task looks along more than 2^16 counts. A key's rank
   is what its directories say plus the bits before its own. Keys that repeat add their number to their word.
2. Leaves go into arrays of 2^8 slots by rank. An array is reduced by eight levels at once, then the arrays'
   tops go into arrays in turn, until one node a group is left; groups likewise.
3. Going back, every array learns the siblings above it, so that each leaf has its whole path at hand.

Nothing is collected but the root, the number of groups and the height of the highest tree; no task holds more than one array and its path, however
large a group or however often a key repeats.

Cases: a null field counts as ``-``, which no value can look like. Null keys come first in their group, the null
group first of all. Equal keys stand in the order of their leaves' digests (of 60 bits, which are taken to differ
where leaves differ); repeated rows stand side by side, each with its own proof. Fields are taken whole, byte by
byte, so that bytes that are no UTF-8 count as they are. Other columns take no part. An empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from banterscope.session import materialise

# An array of slots takes this many levels at once.
LEVELS = 8
# Words that a directory's run has, as a power of two; and how many directories lie above the words' own.
RUN = 16
DIRECTORIES = 3
# Copies of one row that are dealt out at a time.
COPIES = 1 << 16
# What stands before a sibling in a path: none, a sibling to the left, one to the right.
_ALONE, _LEFT, _RIGHT = b"\0", b"\1", b"\2"


def digest(fields: Sequence[Column]) -> Column:
    """The leaf of a row, as 32 bytes: every field with its length before it, or ``-`` if null."""
    told = (F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")) for f in fields)
    return F.unhex(F.sha2(F.concat(*(F.coalesce(t, F.lit("-")) for t in told)), 256))


def _numbered(values: DataFrame, column: str, into: str) -> DataFrame:
    """Distinct values with their place in the order, null first. Sorted by ranges; only counts a range meet."""
    placed = values.orderBy(F.col(column).asc_nulls_first()).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed, "groups").withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    within = F.col("_at") - F.shiftleft("_part", 33)
    return placed.join(offsets, "_part").select(column, (F.col("_before") + within).alias(into))


def _directories(words: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, _word, _base``: the weight of all words before, level by level."""
    levels = []
    level = words.select(*groups, F.col("_word").alias("_id"), "_total")
    for depth in range(DIRECTORIES + 1):
        level = level.withColumn("_up", F.shiftright("_id", RUN) if depth < DIRECTORIES else F.lit(0).cast("long"))
        earlier = W.partitionBy(*groups, "_up").orderBy("_id").rowsBetween(W.unboundedPreceding, -1)
        levels.append(level.select(*groups, "_id", "_up", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base")))
        level = level.groupBy(*groups, F.col("_up").alias("_id")).agg(F.sum("_total").alias("_total"))
    found = levels.pop().drop("_up")
    while levels:
        above = found.select(*groups, F.col("_id").alias("_up"), F.col("_base").alias("_above"))
        found = levels.pop().join(above, [*groups, "_up"]).select(*groups, "_id", (F.col("_base") + F.col("_above")).alias("_base"))
    return found.withColumnRenamed("_id", "_word")


def ranked(rows: DataFrame, groups: list[str], key: str, weight: str, into: str) -> DataFrame:
    """``rows`` with the weight of all rows of the group whose key is less, and ``_same``: that of the key itself.

    ``groups`` and ``key`` are longs without nulls.
    """
    word, bit = F.shiftright(key, 6), F.col(key).bitwiseAND(63).cast("int")
    keys = rows.groupBy(*groups, key).agg(F.sum(weight).alias("_weight"))
    more = F.when(F.col("_weight") > 1, F.struct(bit.alias("bit"), (F.col("_weight") - 1).alias("more")))
    words = keys.groupBy(*groups, word.alias("_word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({key} & 63 as int))")).alias("_bits"),
        F.sum("_weight").alias("_total"),
        F.collect_list(more).alias("_more"),  # at most 64
    )
    words = materialise(words, "words")
    words = words.join(_directories(words, groups), [*groups, "_word"]).drop("_total")
    smaller = F.bitwise_not(F.expr(f"shiftleft(-1L, cast({key} & 63 as int))"))
    total = lambda test: F.aggregate(F.filter("_more", test), F.lit(0).cast("long"), lambda t, x: t + x["more"])
    before = F.col("_base") + F.bit_count(F.col("_bits").bitwiseAND(smaller)) + total(lambda x: x["bit"] < bit)
    joined = rows.withColumn("_word", word).join(words, [*groups, "_word"])
    return joined.select(*rows.columns, before.alias(into), (1 + total(lambda x: x["bit"] == bit)).alias("_same"))


def _placed(counted: DataFrame, key: str) -> DataFrame:
    """``g, pos, key, leaf, other`` of every row, copies side by side; from ``g, key, leaf, other, n`` of different rows."""
    nulls = counted.where(F.col(key).isNull()).groupBy("g").agg(F.sum("n").alias("_nulls"))
    known = ranked(counted.where(F.col(key).isNotNull()), ["g"], key, "n", "pos")
    known = known.join(nulls, "g", "left").withColumn("pos", F.col("pos") + F.coalesce("_nulls", F.lit(0))).drop("_nulls")
    unknown = counted.where(F.col(key).isNull()).withColumn("pos", F.lit(0).cast("long")).withColumn("_same", F.lit(None).cast("long"))
    rows = materialise(known.unionByName(unknown), "ranks")
    # Different rows of one key, or of none, stand by their digests.
    tied = F.col("_same").isNull() | (F.col("_same") > F.col("n"))
    ties = rows.where(tied).drop("_same")
    if not ties.isEmpty():
        short = F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long")
        ties = ties.withColumn("_tie", F.coalesce(key, F.lit(0))).withColumn("_none", F.col(key).isNull().cast("long")).withColumn("_short", short)
        ties = ranked(ties, ["g", "_none", "_tie"], "_short", "n", "_within").withColumn("pos", F.col("pos") + F.col("_within"))
        rows = rows.where(~tied).select(counted.columns + ["pos"]).unionByName(ties.select(counted.columns + ["pos"]))
    # Copies are dealt out in two steps, so that no array is long.
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))).alias("_many"))
    within = F.sequence(F.lit(0).cast("long"), F.least(F.lit(COPIES - 1), F.col("n") - 1 - F.col("_many") * COPIES))
    rows = rows.select("*", F.explode(within).alias("_one"))
    return rows.select("g", (F.col("pos") + F.col("_many") * COPIES + F.col("_one")).alias("pos"), key, "leaf", "other")


def _reduce(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The levels of a tree over hex digests, from the nodes up."""
    out = [nodes]
    for _ in range(levels):
        out.append([sha256(b"".join(nodes[i : i + 2])).hexdigest().encode() for i in range(0, len(nodes), 2)])
        nodes = out[-1]
    return out


def _path(tree: list[list[bytes]], slot: int) -> bytes:
    """The siblings of a slot, level by level."""
    out = []
    for level in tree[:-1]:
        other = slot ^ 1
        if other >= len(level):
            out.append(_ALONE)
        else:
            out.append((_LEFT if other < slot else _RIGHT) + level[other])
        slot >>= 1
    return b"".join(out)


def _slots(table: pa.Table, column: str) -> tuple[list[int], list[bytes]]:
    """The rows of an array in the order of their slots, and the hex digests there."""
    spots = table.column("pos").to_pylist()
    low = min(spots)
    order = [0] * len(spots)
    for row, pos in enumerate(spots):
        order[pos - low] = row
    digests = table.column(column).to_pylist()
    return order, [digests[row].hex().encode() for row in order]


def _tops(key: tuple, table: pa.Table) -> pa.Table:
    left = table.column("left")[0].as_py()
    _, nodes = _slots(table, "node")
    top = _reduce(nodes, min(LEVELS, left))[-1][0]
    columns = {"t": [key[0].as_py()], "pos": [key[1].as_py()], "left": [max(0, left - LEVELS)], "node": [bytes.fromhex(top.decode())]}
    return pa.table(columns, pa.schema([("t", pa.int64()), ("pos", pa.int64()), ("left", pa.int32()), ("node", pa.binary())]))


def _block() -> Column:
    return F.shiftright("pos", LEVELS).alias("block")


def _raised(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Tables ``t, pos, left, node`` of every round, from the given one up to one node a tree."""
    rounds = [nodes]
    for _ in range(0, height, LEVELS):
        grouped = rounds[-1].select("*", _block()).groupBy("t", "block")
        rounds.append(materialise(grouped.applyInArrow(_tops, "t long, pos long, left int, node binary"), "nodes"))
    return rounds


def _paths_below(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
    order, digests = _slots(nodes, "node")
    tree = _reduce(digests, min(LEVELS, nodes.column("left")[0].as_py()))
    rest, spots, trees = above.column("path")[0].as_py(), nodes.column("pos").to_pylist(), nodes.column("t").to_pylist()
    columns = [[trees[row] for row in order], [spots[row] for row in order], [_path(tree, slot) + rest for slot in range(len(order))]]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["t", "pos", "path"])


def _lowered(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """``t, pos, path`` of the lowest of these rounds, from those of the highest one."""
    paths = top
    for nodes in reversed(rounds[:-1]):
        one, two = nodes.select("*", _block()).groupBy("t", "block"), paths.groupBy("t", "pos")
        paths = materialise(one.cogroup(two).applyInArrow(_paths_below, "t long, pos long, path binary"), "paths")
    return paths


def _steps(path: bytes) -> list[tuple[bytes, bytes]]:
    """A path as its sides and siblings."""
    out, at = [], 0
    while at < len(path):
        side = path[at : at + 1]
        size = 0 if side == _ALONE else 64
        out.append((side, path[at + 1 : at + 1 + size]))
        at += 1 + size
    return out


def fold(leaf: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to, as hex."""
    for side, other in steps:
        leaf = sha256(other + leaf if side == _LEFT else leaf + other).hexdigest().encode()
    return leaf


def _proofs(rows: pa.Table, above: pa.Table) -> pa.Table:
    order, leaves = _slots(rows, "node")
    tree = _reduce(leaves, min(LEVELS, rows.column("left")[0].as_py()))
    rest = _steps(above.column("path")[0].as_py())
    subroot, root = (above.column(c)[0].as_py().hex() for c in ("subroot", "root"))
    own, others = rows.column("_key").to_pylist(), rows.column("other").to_pylist()
    proofs, folded = [], []
    for slot, row in enumerate(order):
        steps = _steps(_path(tree, slot)) + rest
        proofs.append(sha256(b"".join([other for _, other in steps])).hexdigest())
        leaf = others[row].hex().encode() if others[row] is not None else leaves[slot]
        folded.append(fold(leaf, steps).decode())
    n = len(order)
    columns = [pa.array([own[row] for row in order], pa.int64()), [x.decode() for x in leaves], [subroot] * n, [root] * n, proofs, folded, [f == root for f in folded]]
    return pa.table(columns, ["_key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def _height(n: Column) -> Column:
    """Levels above ``n`` nodes."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def manifest(docs: DataFrame, key: str, group: str, fields: Sequence[Column], suspect: Column | None = None, found: Sequence[Column] = ()) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``fields`` make the leaf. Where ``suspect`` holds, the row is checked as if its fields were ``found``: the root
    is folded from that leaf and the original siblings. ``proof_sha256`` is the digest of all siblings on the way up.
    The key is an integer.
    """
    kind = docs.schema[key].dataType
    other = F.when(suspect, digest(found)) if suspect is not None else F.lit(None).cast("binary")
    leaves = docs.select(F.col(key).cast("long").alias("_key"), F.col(group).alias("_group"), digest(fields).alias("leaf"), other.alias("other"))
    leaves = materialise(leaves, "leaves")
    groups = materialise(_numbered(leaves.select("_group").distinct(), "_group", "g"), "groups")
    named = groups.select(F.col("_group").alias("_name"), "g")
    counted = leaves.join(named, F.col("_group").eqNullSafe(F.col("_name"))).groupBy("g", "_key", "leaf")
    counted = materialise(counted.agg(F.any_value("other").alias("other"), F.count("*").alias("n")), "rows")
    sizes = materialise(counted.groupBy("g").agg(F.sum("n").alias("_size")).select("g", _height(F.col("_size")).alias("left")), "heights")
    slots = _placed(counted, "_key").join(sizes, "g")
    slots = materialise(slots.select(F.col("g").alias("t"), "pos", "left", F.col("leaf").alias("node"), "_key", "other"), "slots")
    tallest, trees = sizes.agg(F.max("left"), F.count("*")).first()
    # The tree of each group, then the one over all groups.
    rounds = _raised(slots.select("t", "pos", "left", "node"), tallest or 0)
    height = (trees - 1).bit_length() if trees else 0
    subroots = rounds[-1].select(F.lit(0).cast("long").alias("t"), F.col("t").alias("pos"), F.lit(height).alias("left"), "node")
    upper = _raised(subroots, height)
    start = upper[-1].select("t", "pos", F.lit(b"").alias("path"))
    paths = _lowered(upper, start).select(F.col("pos").alias("t"), F.lit(0).cast("long").alias("pos"), "path")
    paths = _lowered(rounds[1:], paths) if len(rounds) > 1 else paths
    root = upper[-1].first()
    above = paths.join(rounds[-1].select("t", F.col("node").alias("subroot")), "t").withColumn("root", F.lit(bytes(root["node"]) if root else b""))

    def prove(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        return _proofs(rows, above)

    grouped = slots.select("*", _block()).groupBy("t", "block").cogroup(above.groupBy("t", "pos"))
    schema = "_key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return grouped.applyInArrow(prove, schema).select(F.col("_key").cast(kind).alias(key), *(c.split()[0] for c in schema.split(", ")[1:]))
