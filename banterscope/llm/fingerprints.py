"""Fingerprints of texts by consistent weighted sampling.

A text is its words (runs of ASCII letters, digits and anything beyond ASCII, without ASCII case) with their
counts as weights. For each sample and word, gamma and uniform variables drawn from the word's hash alone give
a key; the word with the least key, together with its rounded weight, is the sample (Ioffe's improved
consistent weighted sampling). Two texts agree in a sample with the probability of their generalised Jaccard
similarity, so the share of equal samples estimates it.

Cases: null texts count as empty; texts without words share one fingerprint of their own, which agrees with no
other. Equal texts have equal fingerprints. Rows with equal or null keys stand next to each other in an order
fixed by key (nulls first) and text. Texts are read whole.
Bytes that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banterscope.llm.blocks import WordTable, kept, mix, seeds, text_blocks
from banterscope.session import materialise

SAMPLES = 64
# Words whose variables one worker remembers. A memory bound only: they are drawn from the hash again.
REMEMBERED_WORDS = 1 << 16


class Sampler:
    """Draws the samples; remembers the variables of words it has met."""

    def __init__(self) -> None:
        self.table = WordTable.alphanumeric()
        self.rate = np.empty((REMEMBERED_WORDS, SAMPLES), np.float32)
        self.shift, self.level = np.empty_like(self.rate), np.empty_like(self.rate)
        self.words = np.empty(0, np.uint64)  # sorted
        self.rows = np.empty(0, np.int64)

    def _variables(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rate ~ Gamma(2, 1), level = ln of another such, shift ~ uniform, for each word and sample."""
        with np.errstate(over="ignore"):
            base = mix(words[:, None] + seeds(SAMPLES, 3)[None, :])

            def uniform(n: int) -> np.ndarray:
                return ((mix(base + seeds(5, 4)[n]) >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-24)

            rate = -np.log(uniform(0) * uniform(1))
            level = np.log(-np.log(uniform(2) * uniform(3)))
            return rate, uniform(4), level

    def _rows(self, words: np.ndarray) -> np.ndarray:
        """Rows of the remembered table for sorted distinct words."""
        if len(words) > REMEMBERED_WORDS:
            raise ValueError("too many words at once")
        at = np.searchsorted(self.words, words)
        new = np.ones(len(words), bool)
        inside = at < len(self.words)
        new[inside] = self.words[at[inside]] != words[inside]
        if len(self.words) + new.sum() > REMEMBERED_WORDS:
            self.words, self.rows, at, new = self.words[:0], self.rows[:0], np.zeros(len(words), np.int64), np.ones(len(words), bool)
        fresh = np.arange(len(self.words), len(self.words) + new.sum())
        self.rate[fresh], self.shift[fresh], self.level[fresh] = self._variables(words[new])
        self.words = np.insert(self.words, at[new], words[new])
        self.rows = np.insert(self.rows, at[new], fresh)
        return self.rows[np.searchsorted(self.words, words)]

    def sample(self, words: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """32-bit samples, one row a text; text ``i`` has the words from ``starts[i]`` to ``starts[i + 1]``, at least one."""
        out = np.empty((len(starts) - 1, SAMPLES), np.uint32)
        distinct, which = np.unique(words, return_inverse=True)
        log = np.log(weights).astype(np.float32)
        if len(distinct) > REMEMBERED_WORDS:  # a text of very many words: its keys are taken part by part
            return self._sample_parts(words, log, starts)
        rows = self._rows(distinct)[which]
        rate, level = self.rate[rows], self.level[rows]
        step = np.floor(log[:, None] / rate + self.shift[rows])
        keys = level - rate * (step - self.shift[rows]) - rate
        least = np.minimum.reduceat(keys, starts[:-1], 0)
        hit = keys == np.repeat(least, np.diff(starts), 0)
        with np.errstate(over="ignore"):
            sign = (mix(words[:, None] + seeds(1, 5)[0] * step.astype(np.int64).view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
        # Where two words have the same key, the larger sign stands for both.
        return np.maximum.reduceat(np.where(hit, sign, 0), starts[:-1], 0, out=out)

    def _sample_parts(self, words: np.ndarray, log: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts) - 1, SAMPLES), np.uint32)
        size = REMEMBERED_WORDS // 8
        for i in range(len(starts) - 1):
            best = np.full(SAMPLES, np.inf, np.float32)
            for at in range(starts[i], starts[i + 1], size):
                own = words[at : min(at + size, starts[i + 1])]
                rate, shift, level = self._variables(own)
                step = np.floor(log[at : at + len(own), None] / rate + shift)
                keys = level - rate * (step - shift) - rate
                least = keys.min(0)
                with np.errstate(over="ignore"):
                    sign = (mix(own[:, None] + seeds(1, 5)[0] * step.astype(np.int64).view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
                top = np.where(keys == least, sign, 0).max(0)
                out[i] = np.where(least < best, top, np.where(least == best, np.maximum(out[i], top), out[i]))
                best = np.minimum(best, least)
        return out

    def fingerprints(self, texts: list[bytes]) -> np.ndarray:
        """One row of samples a text; zeros for a text without words."""
        hashes, _, _, firsts, _ = self.table.words(texts)
        counts = np.diff(firsts)
        out = np.zeros((len(texts), SAMPLES), np.uint32)
        # Distinct words of each text, with their counts.
        text = np.repeat(np.arange(len(texts)), counts)
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(first)
        words, owner, weights = hashes[at], text[at], np.diff(np.append(at, len(hashes)))
        some = np.flatnonzero(counts > 0)
        # A few thousand words at a time keep the keys in a small amount of memory.
        ends = np.searchsorted(owner, some, "right")
        start = done = 0
        while done < len(some):
            to = max(done + 1, int(np.searchsorted(ends, start + 8192, "right")))
            cut = np.concatenate([[start], ends[done:to]])
            out[some[done:to]] = self.sample(words[start : cut[-1]], weights[start : cut[-1]], cut - start)
            start, done = int(cut[-1]), to
        return out


def sampler() -> Sampler:
    return kept("weighted samples", Sampler)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(-1)


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many characters of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint`` for every row: the samples as hexadecimal digits, eight each. No shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler()
        for batch in batches:
            for rows, texts in text_blocks(batch, text):
                prints = [row.astype(">u4").tobytes().hex() for row in own.fingerprints(texts)]
                yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(prints, pa.string())], [key, "fingerprint"])

    return docs.select(key, F.make_valid_utf8(text).alias(text)).mapInArrow(run, f"`{key}` {kind}, fingerprint string")


# As bytes until the end: half as large on disk as their digits.
_BYTES = ("edited_sha256", "fingerprint", "edited_fingerprint")
_OUT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(own: Sampler, keys: list, texts: list[bytes], nexts: list[bytes]) -> dict[str, list]:
    """The comparison of each text with its edited form and with the next text."""
    plain = [t.decode("utf-8") for t in texts]
    changed = [edited(a, b.decode("utf-8")).encode("utf-8") for a, b in zip(plain, nexts, strict=True)]
    if nexts[:-1] == texts[1:]:  # neighbours: each text is sampled once
        prints = own.fingerprints([*texts, nexts[-1]])
        mine, following = prints[:-1], prints[1:]
    else:
        mine, following = own.fingerprints(texts), own.fingerprints(nexts)
    other = own.fingerprints(changed)
    raw = lambda rows: [row.astype(">u4").tobytes() for row in rows]
    return {
        "key": keys,
        "n_chars": [len(t) for t in plain],
        "edited_sha256": [hashlib.sha256(t).digest() for t in changed],
        "fingerprint": raw(mine),
        "edited_fingerprint": raw(other),
        "near_edited": likeness(mine, other).tolist(),
        "near_next": likeness(mine, following).tolist(),
    }


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited form, and how like they and the next text's are.

    Rows are dealt into ranges of the key and sorted there, so that the next text is the next row of the same
    task. Only the first and the last row of each range, two for a task, meet again in a small second step that
    closes the gaps between ranges and joins the last row to the first.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", *(c.split()[0] for c in _OUT.split(", "))]
    schema = f"key {kind}, {_OUT}, edge int, text binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, begun = sampler(), None, False
        types = None
        for batch in batches:
            types = batch.schema.field("key").type
            for rows, texts in text_blocks(batch, "text"):
                keys = rows.column("key").to_pylist()
                if not begun:
                    begun = True
                    yield _edge(keys[0], texts[0], 0, types)
                if held is not None:
                    keys, texts = [held[0], *keys], [held[1], *texts]
                held = keys[-1], texts[-1]
                if len(texts) > 1:
                    prints = _compared(own, keys[:-1], texts[:-1], texts[1:])
                    n = len(keys) - 1
                    arrays = [pa.array(prints["key"], types), *(pa.array(prints[c]) for c in names[1:]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, [*names, "edge", "text"])
        if held is not None:
            yield _edge(*held, 1, types)

    def _edge(own_key, own_text: bytes, last: int, types: pa.DataType) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        arrays = [pa.array([own_key], types), *(pa.nulls(1, t) for t in kinds), pa.array([last], pa.int32()), pa.array([own_text], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, [*names, "edge", "text"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler()
        for batch in batches:
            texts, nexts = ([t or b"" for t in batch.column(c).to_pylist()] for c in ("text", "following"))
            prints = _compared(own, batch.column("key").to_pylist(), texts, nexts)
            yield pa.RecordBatch.from_arrays([pa.array(prints["key"], batch.schema.field("key").type), *(pa.array(prints[c]) for c in names[1:])], names)

    plain = docs.select(F.col(key).alias("key"), F.coalesce(F.make_valid_utf8(text), F.lit("")).alias("text"))
    ranged = plain.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    done = materialise(ranged.mapInArrow(run, schema), "fingerprints")
    inner = done.where(F.col("edge").isNull()).select(*names)
    # Two rows a range: in order, each last one is followed by the first one of the next range.
    edges = done.where(F.col("edge").isNotNull()).select("key", "text", "edge")
    order = [F.col("key").asc_nulls_first(), F.col("text"), F.col("edge")]
    from pyspark.sql import Window as W

    ordered = edges.select("*", F.lead("text").over(W.orderBy(*order)).alias("_next"), F.first("text").over(W.orderBy(*order)).alias("_first"))
    lasts = ordered.where("edge = 1").select("key", "text", F.coalesce("_next", "_first").alias("following"))
    closed = lasts.repartition("key").mapInArrow(close, f"key {kind}, {_OUT}")
    whole = inner.unionByName(closed)
    return whole.withColumns({c: F.lower(F.hex(c)) for c in _BYTES}).withColumnRenamed("key", key)
