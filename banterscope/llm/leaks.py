"""Benchmark items inside documents, by size-partitioned MinHash containment search.

An item's set holds its runs of ``width`` words (ASCII case and punctuation apart). A document contains an item
if it has at least ``share`` of ``parts`` of the item's runs. Items are dealt into classes by the power of two
of their set's size, and each class keeps a MinHash sketch of every item: its least hashes, so many that a
document without any of them can't reach the share (one more than the items of the class may lack). A document
is a candidate for an item if it has a hash of the item's sketch. Documents need no signature of their own: one
over a whole long document would lose a short item, and the sketch finds it at every document length, without
misses. Candidates are verified by the exact number of common runs.

A bitmap of fixed size, sent to all tasks, lets only runs leave the scan that some item may have.

Cases: null and empty texts contain nothing; items without words are in no document; items of fewer words are
searched as their whole sequence. Rows with the same key and text count once; a null key is kept as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banterscope.llm.blocks import BitFilter, WordTable, filter_of, kept, mix, shingles, text_blocks
from banterscope.session import materialise

FILTER_LOG = 25


def _runs(texts: list[bytes], width: int, widths: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of ``widths``: the text's number and the hash of every run. A hash depends on the width."""
    hashes, _, _, firsts, _ = kept("alphanumeric words", WordTable.alphanumeric).words(texts)
    counts = np.diff(firsts)
    for w in widths:
        values, starts = shingles(hashes, firsts, w)
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        whole = counts[owner] >= w
        yield owner[whole], mix(values[whole] + np.uint64(w)) if w < width else values[whole]


def item_runs(items: DataFrame, key: str, text: str, width: int, share: int, parts: int) -> DataFrame:
    """``item, words, n, token, sketch``: every distinct run of every item, and whether the sketch has it."""
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_blocks(batch, text):
                _, _, _, firsts, _ = kept("alphanumeric words", WordTable.alphanumeric).words(texts)
                words = np.minimum(np.diff(firsts), width)
                found = {w: v for w, v in zip(range(1, width + 1), _runs(texts, width, tuple(range(1, width + 1))), strict=True)}
                names = rows.column(key)
                for i, w in enumerate(words.tolist()):
                    if not w:
                        continue
                    owner, values = found[w]
                    tokens = np.unique(values[owner == i])
                    n = len(tokens)
                    top = 1 << (n - 1).bit_length()
                    lack = top * (parts - share) // parts
                    least = np.arange(n) <= lack
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[i].as_py()] * n, names.type), pa.array([w] * n, pa.int32()), pa.array([n] * n, pa.int64()), pa.array(tokens.view(np.int64)), pa.array(least)],
                        ["item", "words", "n", "token", "sketch"],
                    )

    found = items.select(key, text).mapInArrow(run, f"item {kind}, words int, n long, token long, sketch boolean")
    return materialise(found.distinct(), "items")


def contained(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = 5, share: int = 80, parts: int = 100,
) -> DataFrame:
    """``key, tag, item, shared, n_item`` of every document and item that it contains; ``tag`` is the text's hash."""
    kind = docs.schema[key].dataType.simpleString()
    runs = item_runs(items, item, item_text, width, share, parts)
    widths = tuple(sorted(r[0] for r in runs.select("words").distinct().collect()))
    held = docs.sparkSession.sparkContext.broadcast(filter_of(runs.select("token"), FILTER_LOG).bits.tobytes())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BitFilter(held.value)
        for batch in batches:
            for rows, texts in text_blocks(batch, "text"):
                for owner, values in _runs(texts, width, widths):
                    hit = own.has(values)
                    pairs = np.unique(np.stack([owner[hit].astype(np.uint64), values[hit]], 1), axis=0)
                    at = pa.array(pairs[:, 0].astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("key").take(at), rows.column("tag").take(at), pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))], ["key", "tag", "token"]
                    )

    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tag"))
    hits = materialise(plain.mapInArrow(scan, f"key {kind}, tag long, token long"), "hits")
    one_row = [F.coalesce(F.col("key").cast("string"), F.lit("")).alias("_key"), F.col("key").isNull().alias("_none")]
    hits = hits.select("*", *one_row).distinct()
    candidates = hits.join(runs.where("sketch").select("token", "item"), "token").select("key", "_key", "_none", "tag", "item").distinct()
    wanted = candidates.join(runs.select("item", "token", "n"), "item")
    common = wanted.join(hits.select("_key", "_none", "tag", "token"), ["_key", "_none", "tag", "token"])
    counted = common.groupBy("_key", "_none", "tag", "item").agg(F.any_value("key").alias("key"), F.count("*").alias("shared"), F.any_value("n").alias("n_item"))
    found = counted.where(F.col("shared") * parts >= F.col("n_item") * share)
    return found.select(F.col("key").alias(key), "tag", F.col("item").alias(item), "shared", "n_item")


def without_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that contain no item, unchanged."""
    found = contained(docs, items, key, text, **options).select(F.col(key).alias("_key"), F.col("tag").alias("_tag")).distinct()
    same = docs[key].eqNullSafe(found["_key"]) & (F.coalesce(F.xxhash64(docs[text]), F.lit(0)) == found["_tag"])
    return docs.join(found, same, "left_anti")
