"""Quality of texts by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text is compressed with
both, piece by piece, so that the dictionaries matter from its start to its end. The difference of the
compressed sizes by the text's own size is what separates good from bad; a logistic curve, fitted on labelled
texts that no dictionary has seen, turns it into a probability.

Cases: null texts count as empty; empty texts, and all texts if a label is missing from training, get the score
that the labels' shares give. Equal texts have equal scores. Texts are compressed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banterscope.llm.blocks import kept, text_blocks
from banterscope.llm.samples import sample_per_label

PIECE = 512
DICTIONARY_BYTES = 112_640
LEVEL = 3
# Bounds of the training sample: documents of each label, half for the dictionary and half for the curve; of a
# document for the dictionary, characters from a place that a hash of its text chooses.
SAMPLE_EACH = 1600
SAMPLE_CHARS = 4096


@dataclass(frozen=True)
class QualityModel:
    """Both dictionaries (empty: not trained) and the curve: log odds = offset + slope * difference."""

    good: bytes
    bad: bytes
    slope: float
    offset: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for data in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(data)
            words.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_dict_id=False))
        return out

    def difference(self, text: bytes) -> float:
        """(size with the bad dictionary - size with the good one) / own size; 0 for the empty text."""
        if not text or not self.good:
            return 0.0
        good, bad = kept(("quality", self.good, self.bad), self.compressors)
        g = b = 0
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE]
            g += len(good.compress(piece))
            b += len(bad.compress(piece))
        return (b - g) / len(text)

    def score(self, texts: list[bytes]) -> np.ndarray:
        seen = np.array([self.difference(t) for t in texts])
        some = np.array([bool(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(np.where(some, self.offset + self.slope * seen, self.offset), -50, 50)))


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, pieces)) // 8))
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text for a trained one: the text itself serves
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _curve(x: np.ndarray, y: np.ndarray, odds: float) -> tuple[float, float]:
    """Logistic regression on one number by Newton's method; both labels weigh as in ``odds``."""
    scale = max(float(np.abs(x).max()), 1e-9)
    design = np.stack([np.ones(len(x)), x / scale], 1)
    weight = np.where(y > 0, odds / max(y.mean(), 1e-9), (1 - odds) / max(1 - y.mean(), 1e-9))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        slope = design.T @ (weight * (y - p)) - 1e-3 * beta
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1] / scale)


def _prior(share: float) -> float:
    return float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6))))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """Train on about ``SAMPLE_EACH`` labelled rows of each label.

    Labels are sampled first, so that only their documents leave the scan; the sample's bound is what makes
    the broadcast safe. Half of the sample builds the dictionaries. The other half is compressed whole, where it
    is read, and only its differences come back to fit the curve.
    """
    rows = labels.select(key, label).where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1) if counts else 0.5
    chosen = sample_per_label(rows, label, key, SAMPLE_EACH).select(key, label).distinct()
    curve = F.pmod(F.xxhash64(F.lit("curve"), key), F.lit(2)) == 1
    some = docs.select(key, F.col(text).alias("text")).where(F.length("text") > 0)
    place = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    piece = F.substring("text", place, F.lit(SAMPLE_CHARS)).alias("piece")
    found = some.join(F.broadcast(chosen.where(~curve)), key).select(key, label, piece).collect()
    found.sort(key=lambda r: (str(r[0]), r[1], r[2]))
    halves = {q: [r[2].encode("utf-8") for r in found if r[1] == q] for q in (0, 1)}
    if min(map(len, halves.values())) < 2:
        return QualityModel(b"", b"", 0.0, _prior(share))
    model = QualityModel(_dictionary(halves[1]), _dictionary(halves[0]), 0.0, _prior(share))

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model
        for batch in batches:
            for part, texts in text_blocks(batch, "text"):
                seen = pa.array([own.difference(t) for t in texts], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("label"), seen], ["label", "difference"])

    rest = some.join(F.broadcast(chosen.where(curve)), key).select("text", F.col(label).cast("double").alias("label"))
    told = sorted((r[0], r[1]) for r in rest.mapInArrow(differences, "label double, difference double").collect())
    if len({q for q, _ in told}) < 2:
        return QualityModel(b"", b"", 0.0, _prior(share))
    offset, slope = _curve(np.array([d for _, d in told]), np.array([q for q, _ in told]), share)
    return QualityModel(model.good, model.bad, slope, offset)


def score(self, texts: list[bytes]) -> np.ndarray:
        seen = np.array([self.difference(t) for t in texts])
        some = np.array([bool(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(np.where(some, self.offset + self.slope * seen, self.offset), -50, 50)))


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, pieces)) // 8))
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text for a trained one: the text itself serves
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _curve(x: np.ndarray, y: np.ndarray, odds: float) -> tuple[float, float]:
    """Logistic regression on one number by Newton's method; both labels weigh as in ``odds``."""
    scale = max(float(np.abs(x).max()), 1e-9)
    design = np.stack([np.ones(len(x)), x / scale], 1)
    weight = np.where(y > 0, odds / max(y.mean(), 1e-9), (1 - odds) / max(1 - y.mean(), 1e-9))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        slope = design.T @ (weight * (y - p)) - 1e-3 * beta
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1] / scale)


def train(texts: list[bytes], labels: list[int], share: float) -> QualityModel:
    """Every other text builds a dictionary, the rest fit the curve. ``share``: of label 1 among all labelled rows."""
    prior = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6))))
    halves = {q: [t for t, own in zip(texts, labels, strict=True) if own == q] for q in (0, 1)}
    if min(map(len, halves.values())) < 4:
        return QualityModel(b"", b"", 0.0, prior)
    model = QualityModel(_dictionary(halves[1][::2]), _dictionary(halves[0][::2]), 0.0, prior)
    x = [(model.difference(t), q) for q in (0, 1) for t in halves[q][1::2]]
    offset, slope = _curve(np.array([v for v, _ in x]), np.array([float(q) for _, q in x]), share)
    return QualityModel(model.good, model.bad, slope, offset)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """Train on about ``SAMPLE_EACH`` labelled rows of each label.

    Labels are sampled first, so that only their documents leave the scan; the sample's bound is what makes
    the broadcast safe.
    """
    rows = labels.select(key, label).where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    chosen = sample_per_label(rows, label, key, SAMPLE_EACH)
    piece = F.substring(F.coalesce(F.col(text), F.lit("")), 1, SAMPLE_CHARS)
    found = docs.select(key, piece.alias("piece")).join(F.broadcast(chosen), key).select(key, label, "piece").collect()
    found.sort(key=lambda r: (str(r[0]), r[1], r[2]))
    found = [r for r in found if r[2]]
    return train([r[2].encode("utf-8") for r in found], [r[1] for r in found], share if counts else 0.5)


def score(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` for every row of ``docs``. No shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model
        for batch in batches:
            for rows, texts in text_blocks(batch, text):
                yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(own.score(texts))], [key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")
