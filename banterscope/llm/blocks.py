"""Small helpers for work on Arrow batches inside tasks.

Words and shingles are hashed a block of texts at a time with numpy. A hash has 64 bits and is the
same in every task, so that a recomputed partition equals the lost one.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STASH = "_banterscope_llm_kept"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACES = bytes([0x20, *range(0x09, 0x0E)])


def kept(key: Any, build: Callable[[], Any]) -> Any:
    """What ``build`` returns, made once in a worker process and kept there for later tasks."""
    stash = sys.modules.setdefault(_STASH, types.ModuleType(_STASH)).__dict__
    if key not in stash:
        stash[key] = build()
    return stash[key]


def make_room(*keep: str) -> None:
    """Lets go of what other operators have kept in this worker process, and gives free memory back to the system.

    A worker serves one stage after the other. What is let go is built again when it is asked for. Keys that are
    tuples begin with the name of what they belong to; the others are small and shared.
    """
    stash = sys.modules.setdefault(_STASH, types.ModuleType(_STASH)).__dict__
    for key in [k for k in stash if isinstance(k, tuple) and k[0] not in keep]:
        del stash[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_blocks(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch whose texts have about ``most`` bytes together, with the texts (null: empty).

    The slicing bounds memory only; every row and every byte comes out, a longer text in a slice of its own.
    """
    texts = batch.column(column).cast(pa.large_binary())
    sizes = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.binary_length(texts.fill_null(b"")).to_numpy(zero_copy_only=False), out=sizes[1:])
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + most, "right")) - 1)
        yield batch.slice(start, end - start), [t or b"" for t in texts.slice(start, end - start).to_pylist()]
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the public splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE) + np.uint64(seed))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def build(size: int) -> tuple[np.ndarray, np.ndarray]:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        both = []
        for base in (_BASE, inverse):
            powers = np.full(size, base)
            powers[0] = 1
            both.append(np.multiply.accumulate(powers))
        return both[0], both[1]

    usual = 1 << 20
    return kept("powers", lambda: build(usual)) if n <= usual else build(n)


class WordTable:
    """Which bytes make words, and what they are hashed as: a table over the 256 bytes.

    ``separators``: bytes between words. ASCII letters count as their lower case.
    """

    def __init__(self, separators: bytes) -> None:
        low = np.arange(256, dtype=np.uint8)
        low[65:91] += 32
        self.separates = np.isin(np.arange(256), np.frombuffer(separators, np.uint8))
        self.values = seeds(256, 1)[low]

    @classmethod
    def spaced(cls) -> WordTable:
        """Words are runs without ASCII white space."""
        return cls(_SPACES)

    @classmethod
    def alphanumeric(cls) -> WordTable:
        """Words are runs of ASCII letters, ASCII digits and anything beyond ASCII."""
        return cls(bytes(b for b in range(128) if not chr(b).isalnum()))

    def words(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Hashes, starts and ends of all words, the first word's number for each text (and the total), the joined bytes."""
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        apart = self.separates[data]
        before = np.empty_like(apart)
        before[0] = True
        before[1:] = apart[:-1]
        starts, ends = np.flatnonzero(before & ~apart), np.flatnonzero(apart & ~before)
        up, down = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * up[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts])
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
        return hashes, starts, ends, np.searchsorted(starts, offsets), joined


def shingles(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within each text, and the first run's number for each text.

    A text with fewer words, but at least one, has its whole sequence as its only run.
    """
    weights = seeds(width + 1, 2) | np.uint64(1)
    counts = np.diff(firsts)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    starts = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(runs, out=starts[1:])
    whole = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for j in range(width):
        whole += hashes[j : j + len(whole)] * weights[j]
    out = np.empty(starts[-1], np.uint64)
    inside = np.ones(len(hashes), bool)
    for back in range(1, width):
        at = firsts[1:] - back
        inside[at[at >= firsts[:-1]]] = False
    long = np.repeat(counts >= width, runs)
    out[long] = mix(whole)[inside[: len(whole)] & np.repeat(counts >= width, counts)[: len(whole)]]
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        own = np.append(hashes[firsts[d] : firsts[d + 1]], np.uint64(counts[d]))
        out[starts[d]] = mix((own * np.append(weights[: len(own) - 1], weights[width])).sum(keepdims=True, dtype=np.uint64))[0]
    return out, starts


class BitFilter:
    """Membership with false positives only, in a fixed number of bits (two probes a key).

    Its size is a parameter and doesn't grow with the keys; when it is full it only lets more through.
    """

    def __init__(self, bits: bytes | np.ndarray) -> None:
        self.bits = np.frombuffer(bits, np.uint8) if isinstance(bits, bytes) else bits
        self.mask = np.uint64(len(self.bits) * 8 - 1)

    @classmethod
    def empty(cls, log_bits: int) -> BitFilter:
        return cls(np.zeros(1 << (log_bits - 3), np.uint8))

    def _spots(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in (keys, keys >> np.uint64(27)):
            at = part & self.mask
            yield (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def add(self, keys: np.ndarray) -> None:
        for at, bit in self._spots(keys):
            np.bitwise_or.at(self.bits, at, bit)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at, bit in self._spots(keys):
            found &= (self.bits[at] & bit) != 0
        return found


def filter_of(keys: DataFrame, log_bits: int, tasks: int = 4) -> BitFilter:
    """A filter over one column of longs. A few tasks read the keys and send a bitmap of fixed size each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BitFilter.empty(log_bits)
        for batch in batches:
            own.add(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        yield pa.RecordBatch.from_pydict({"bits": [own.bits.tobytes()]})

    total = BitFilter.empty(log_bits)
    for row in keys.select(keys.columns[0]).coalesce(tasks).mapInArrow(build, "bits binary").collect():
        total.bits |= np.frombuffer(row["bits"], np.uint8)
    return total


def sized_filter(keys: DataFrame, most_log: int = 27) -> BitFilter:
    """A filter over one column of longs, with some 16 bits for each of them, up to ``2**most_log`` bits.

    Words of bits are OR-ed together by tasks first; what reaches the driver is as large as the filter.
    """
    own = keys.select(F.col(keys.columns[0]).alias("key")).where("key is not null")
    log_bits = min(most_log, max(13, (16 * own.count() - 1).bit_length()))
    mask = (1 << log_bits) - 1
    spots = own.select(F.explode(F.array(F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 27).bitwiseAND(mask))).alias("at"))
    words = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << (log_bits - 6), np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return BitFilter(bits.view(np.uint8))
