"""Language of texts by a byte convolutional network.

Filters of two, three and four bytes run over fixed-length windows of the whole text; the largest response of
each filter in a window feeds a softmax. The network is trained in numpy on a bounded sample of labelled
texts and then applied to all windows in batches. A document's scores are the mean of its windows' logits,
weighted by their letters.

Cases: null texts and texts without a letter are ``und`` with score 0; if nothing labelled was given, all are.
Equal texts have equal predictions. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banterscope.llm.blocks import kept, make_room, text_blocks
from banterscope.llm.samples import sample_per_label

WINDOW = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"
# Bytes at a time; responses take some two hundred times as much memory.
BLOCK = 1 << 18
# Bounds of the training sample: documents of each language, and characters of each document.
SAMPLE_EACH = 500
SAMPLE_CHARS = 1200


def _classes() -> np.ndarray:
    """Bytes as classes: letters without case, bytes beyond ASCII as they are, digits alike, other signs as gaps."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        out[b] = 1 + ord(c.lower()) - 97 if c.isascii() and c.isalpha() else 27 if c.isdigit() else b - 100 if b >= 128 else 0
    return out


CLASSES = _classes()
N_CLASSES = 156
LETTER = (CLASSES > 0) & (CLASSES != 27)


@dataclass(frozen=True)
class LanguageModel:
    """Languages, byte vectors, filters by width (width * vector, filters), and the softmax layer."""

    languages: tuple[str, ...]
    vectors: np.ndarray
    filters: tuple[np.ndarray, ...]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    @property
    def mark(self) -> str:
        """A digest of all parameters, by which a worker knows a model again."""
        parts = (self.vectors, *self.filters, self.bias, self.weights, self.offset)
        return hashlib.sha256(b"".join(a.tobytes() for a in parts)).hexdigest()

    def tables(self) -> list[np.ndarray]:
        """Responses of the filters to pairs of classes, so that a convolution is a sum of look-ups."""

        def part(width: int, at: int, n: int) -> np.ndarray:
            size = self.vectors.shape[1]
            piece = self.filters[WIDTHS.index(width)].reshape(width, size, -1)[at : at + n]
            first = self.vectors @ piece[0]
            return first if n == 1 else (first[:, None, :] + (self.vectors @ piece[1])[None, :, :]).reshape(N_CLASSES**2, -1)

        return [np.ascontiguousarray(t, np.float32) for t in (part(2, 0, 2), part(3, 0, 2), part(3, 2, 1), part(4, 0, 2), part(4, 2, 2))]

    def logits(self, classes: np.ndarray) -> np.ndarray:
        """Of each window in a row of classes whose length is a multiple of the window; its end must be padded."""
        two, three, three_end, four, four_end = kept(("language", self.mark), self.tables)
        n = len(classes)
        c = np.concatenate([classes, np.zeros(4, classes.dtype)]).astype(np.int32)
        pair = c[:-1] * N_CLASSES + c[1:]
        hidden = np.concatenate(
            [
                x.reshape(n // WINDOW, WINDOW, -1).max(1)
                for x in (
                    two.take(pair[:n], 0),
                    three.take(pair[:n], 0) + three_end.take(c[2 : n + 2], 0),
                    four.take(pair[:n], 0) + four_end.take(pair[2 : n + 2], 0),
                )
            ],
            1,
        )
        return np.maximum(hidden + self.bias, 0) @ self.weights + self.offset

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number and its probability for each text."""
        windows = [-(-(len(t) + 4) // WINDOW) for t in texts]
        data = b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, windows, strict=True))
        raw = np.frombuffer(data, np.uint8)
        letters = LETTER[raw].reshape(-1, WINDOW).sum(1).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum(windows)[:-1]])
        total = np.add.reduceat(self.logits(CLASSES[raw]) * letters[:, None], starts, 0)
        total /= np.maximum(np.add.reduceat(letters, starts), 1)[:, None]
        odds = np.exp(total - total.max(1, keepdims=True))
        return total.argmax(1), 1 / odds.sum(1)


def train(texts: list[str], languages: list[str], rounds: int = 12, each: int = 8, size: int = 6) -> LanguageModel | None:
    """Fit the network by stochastic descent with momentum on one window of each text; the same for the same input."""
    names = tuple(sorted(set(languages)))
    if not names:
        return None
    random = np.random.default_rng(7)
    target = np.searchsorted(names, languages)
    room = WINDOW - 4
    cut = []
    for t in texts:
        data = t.encode("utf-8")
        at = int(random.integers(0, max(len(data) - room, 0) + 1))
        cut.append(data[at : at + room].ljust(WINDOW, b"\0"))
    x = CLASSES[np.frombuffer(b"".join(cut), np.uint8)].reshape(-1, WINDOW).astype(np.int64)
    count = len(names)
    share = np.bincount(target, minlength=count)
    balance = (len(target) / count / share)[target]
    hidden = each * len(WIDTHS)
    p = {
        "v": random.normal(0, 0.5, (N_CLASSES, size)),
        **{f"f{w}": random.normal(0, (w * size) ** -0.5, (w * size, each)) for w in WIDTHS},
        "b": np.zeros(hidden),
        "w": random.normal(0, hidden**-0.5, (hidden, count)),
        "o": np.zeros(count),
    }
    first, second, step = {k: 0.0 * v for k, v in p.items()}, {k: 0.0 * v for k, v in p.items()}, 0
    for _ in range(rounds):
        for rows in np.array_split(random.permutation(len(x)), max(1, len(x) // 64)):
            xs = x[rows]
            patches, peaks, tops = {}, {}, []
            for w in WIDTHS:
                spots = np.lib.stride_tricks.sliding_window_view(xs, w, axis=1)
                a = p["v"][spots].reshape(len(rows), spots.shape[1], w * size) @ p[f"f{w}"]
                peaks[w] = a.argmax(1)
                tops.append(a.max(1))
                patches[w] = np.take_along_axis(spots, peaks[w][:, :, None], 1)  # rows, filters, width
            h = np.concatenate(tops, 1) + p["b"]
            active = np.maximum(h, 0)
            z = active @ p["w"] + p["o"]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(rows)), target[rows]] -= 1
            z *= (balance[rows] / len(rows))[:, None]
            back = (z @ p["w"].T) * (h > 0)
            g = {"w": active.T @ z + 1e-4 * p["w"], "o": z.sum(0), "b": back.sum(0), "v": np.zeros_like(p["v"])}
            for k, w in enumerate(WIDTHS):
                own = back[:, k * each : (k + 1) * each]
                seen = p["v"][patches[w]].reshape(len(rows), each, w * size)
                g[f"f{w}"] = np.einsum("re,rei->ie", own, seen) + 1e-4 * p[f"f{w}"]
                to = np.einsum("re,ie->rei", own, p[f"f{w}"]).reshape(len(rows), each, w, size)
                np.add.at(g["v"], patches[w].reshape(-1), to.reshape(-1, size))
            step += 1
            for k in p:  # Adam
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    f32 = lambda a: a.astype(np.float32)
    return LanguageModel(names, f32(p["v"]), tuple(f32(p[f"f{w}"]) for w in WIDTHS), f32(p["b"]), f32(p["w"]), f32(p["o"]))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel | None:
    """Train on a bounded sample: about ``SAMPLE_EACH`` rows a language, a piece of ``SAMPLE_CHARS`` from each."""
    rows = labelled.select(key, lang, text).where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    at = F.pmod(F.xxhash64(F.lit("piece"), F.col(key)), F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    piece = F.substring(F.col(text), at.cast("int"), F.lit(SAMPLE_CHARS))
    found = sample_per_label(rows, lang, key, SAMPLE_EACH).select(key, lang, piece.alias("piece")).collect()
    found.sort(key=lambda r: (r[1], str(r[0]), r[2]))
    return train([r[2] for r in found], [r[1] for r in found])


def label(texts: list[bytes], model: LanguageModel | None) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    known = [model is not None and any(map(str.isalpha, t.decode("utf-8", "replace"))) for t in texts]
    if not any(known):
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    best, score = model.predict(texts)
    return (
        [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known, strict=True)],
        [s if k else 0.0 for s, k in zip(score.tolist(), known, strict=True)],
    )


def predict(docs: DataFrame, model: LanguageModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` for every row of ``docs``. No shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model
        for batch in batches:
            for rows, texts in text_blocks(batch, text, BLOCK):
                names, scores = label(texts, own)
                yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(names), pa.array(scores)], [key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel | None, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is found with at least this score; all their columns, unchanged.

    Only texts go through Python; the rows wait in the JVM.
    """

    @F.arrow_udf("boolean")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = model
        make_room("language")
        for column in batches:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            good: list[bool] = []
            for _, texts in text_blocks(batch, "text", BLOCK):
                good += [n != UNKNOWN and s >= least for n, s in zip(*label(texts, own), strict=True)]
            yield pa.array(good, pa.bool_())

    return docs.where(found(F.col(text)))
