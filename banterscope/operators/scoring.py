"""Scorers: each turns a list of texts into a list of ``STRUCT<score, detail>``.

The default scorer is made of built-in functions. A Python model runs as an Arrow-batched
pandas UDF, a ``spark.ml`` model as a DataFrame transformation.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from importlib import import_module
from typing import Protocol

import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from banterscope.functions import probability
from banterscope.functions.text import ascii_lower
from banterscope.operators import models
from banterscope.schema import SCORE


class Scorer(Protocol):
    def attach(self, df: DataFrame, texts: str, into: str) -> DataFrame:
        """Add ``into ARRAY<STRUCT<score, detail>>``, aligned with ``texts ARRAY<STRING>``."""


# Words that give an attribute away: a small choice of our own, exchanged by the ``words`` of a scorer.
LEXICON = {
    "IDENTITY_ATTACK": ("scum", "trash", "clown"),
    "INSULT": ("idiot", "moron", "stupid", "loser"),
    "SEXUALLY_EXPLICIT": ("worthless", "pathetic", "disgusting"),
}


@dataclass(frozen=True)
class LexiconScorer:
    """Counts listed words per attribute and conflates the attribute probabilities.

    A word is a run of ASCII letters, in any case. One pass of one pattern finds the
    words of all attributes; only the few matches are then told apart.
    """

    words: Mapping[str, Sequence[str]] = field(default_factory=lambda: LEXICON)
    base: float = 0.05
    per_hit: float = 0.30
    ceiling: float = 0.95

    def _pattern(self) -> str:
        every = [w for words in self.words.values() for w in words]
        first = "".join(sorted({re.escape(c) for w in every for c in (w[0].lower(), w[0].upper())}))
        return f"(?<![a-zA-Z])(?=[{first}])(?i:{'|'.join(map(re.escape, every))})(?![a-zA-Z])"

    def hits(self, text: Column) -> Column:
        """The listed words in a text, lower-cased."""
        return F.transform(F.regexp_extract_all(text, F.lit(self._pattern()), F.lit(0)), F.lower)

    def probabilities(self, hits: Column) -> list[Column]:
        counts = [_count_listed(hits, self.words[name]) for name in probability.ATTRIBUTES]
        return [F.least(self.base + self.per_hit * n, F.lit(self.ceiling)) for n in counts]

    def attach(self, df: DataFrame, texts: str, into: str) -> DataFrame:
        # One step per stage, each over the array of the one before: nothing is computed
        # twice, and no step looks back into an outer array.
        probs = F.transform(F.transform(texts, self.hits), self._probability_struct)
        payloads = F.transform(
            probs, lambda p: F.when(p.isNotNull(), probability.score_payload([p[f"p{i}"] for i in range(3)]))
        )
        return df.withColumn(into, payloads)

    def _probability_struct(self, hits: Column) -> Column:
        named = [p.alias(f"p{i}") for i, p in enumerate(self.probabilities(hits))]
        return F.when(hits.isNotNull(), F.struct(*named))

    def score_rows(self, df: DataFrame, text: str = "text") -> DataFrame:
        """One text per row: add ``score`` and one column per attribute."""
        probs = self.probabilities(F.col("_hits"))
        named = {f"_p{i}": F.when(F.col("_hits").isNotNull(), p) for i, p in enumerate(probs)}
        p = [F.col(name) for name in named]
        return (
            df.withColumn("_hits", self.hits(F.col(text)))
            .withColumns(named)
            .withColumn("score", probability.conflate(p))
            .withColumns({a.lower(): c for a, c in zip(probability.ATTRIBUTES, p)})
            .drop("_hits", *named)
        )


def _count_listed(hits: Column, words: Sequence[str]) -> Column:
    low = [w.lower() for w in words]
    return F.size(F.filter(hits, lambda hit: hit.isin(*low)))


@dataclass(frozen=True)
class AttributeTableScorer:
    """Looks scores up in a table of attribute responses keyed by text.

    ``responses`` has ``(text, response JSON)``; where a text has several responses, the least
    one counts. Messages meet it by a join on the text digest, so neither side is collected or
    broadcast by us. A text that everybody sends is a hot key of the left side only, which
    adaptive execution splits.
    """

    responses: DataFrame

    def attach(self, df: DataFrame, texts: str, into: str) -> DataFrame:
        one = self.responses.groupBy(F.sha2("text", 256).alias("_digest")).agg(F.min("response").alias("_response"))
        parsed = one.select("_digest", F.try_parse_json("_response").alias("_r"))
        payload = probability.score_payload(probability.attribute_probabilities(F.col("_r")))
        table = parsed.select("_digest", payload.alias("_payload"))
        return _score_by_row(df, texts, into, lambda rows: _lookup(rows, table))


def _lookup(rows: DataFrame, table: DataFrame) -> DataFrame:
    digest = rows.withColumn("_digest", F.sha2("_text", 256))
    return digest.join(table, "_digest", "left").drop("_digest", "_text")


@dataclass(frozen=True)
class PandasScorer:
    """Wraps a Python model that scores a batch of texts.

    ``load`` is called once per task and returns ``texts -> frame`` where the frame has a
    ``score`` column and any number of detail columns. A NULL text is not passed on.
    """

    load: Callable[[], Callable[[pd.Series], pd.DataFrame]]

    def attach(self, df: DataFrame, texts: str, into: str) -> DataFrame:
        load = self.load

        @F.pandas_udf(T.ArrayType(SCORE))
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for lists in batches:
                flat = lists.explode()
                given = flat[flat.notna()]
                frame = model(given.reset_index(drop=True)) if len(given) else pd.DataFrame({"score": []})
                details = [c for c in frame.columns if c != "score"]
                results = iter(frame.to_dict("records"))
                yield lists.map(
                    lambda ts: None
                    if ts is None
                    else [_payload(next(results), details) if t is not None else None for t in ts]
                )

        return df.withColumn(into, score(F.col(texts)))


def _payload(row: dict, details: list[str]) -> dict:
    score = row["score"]
    return {
        "score": None if pd.isna(score) else float(score),
        "detail": {name: float(row[name]) for name in details},
    }


@dataclass(frozen=True)
class LinearTextScorer:
    """A fitted text pipeline as plain columns: row-local, so that it can score a stream.

    The score is the logistic function of the intercept and the weights of the words that
    occur. Few words have a weight, as the training drops most of them. With ``buckets``,
    the weights are those of the words' buckets.
    """

    weights: Mapping[str, float]
    intercept: float
    buckets: int | None = None

    @classmethod
    def from_model(cls, model: PipelineModel) -> LinearTextScorer:
        return cls(*models.bucket_weights(model))

    def score_column(self, text: Column) -> Column:
        words = F.regexp_extract_all(F.lower(text), F.lit(models.WORD), F.lit(0))
        if self.buckets is not None:
            words = F.transform(words, lambda w: models.bucket(w, self.buckets).cast("string"))
        words = F.array_distinct(words)
        table = F.from_json(F.lit(json.dumps(self.weights)), "map<string,double>")
        # Membership in a fixed set is a hash look-up; only the few hits search the map.
        known = F.filter(words, lambda w: w.isin(*self.weights))
        margin = F.aggregate(known, F.lit(self.intercept), lambda sum_, w: sum_ + table[w])
        return 1 / (1 + F.exp(-margin))

    def attach(self, df: DataFrame, texts: str, into: str) -> DataFrame:
        nothing = F.lit(None).cast("map<string,double>")

        def payload(text: Column) -> Column:
            score = F.struct(self.score_column(text).alias("score"), nothing.alias("detail"))
            return F.when(text.isNotNull(), score)

        return df.withColumn(into, F.transform(texts, payload))


@dataclass(frozen=True)
class SparkMLScorer:
    """Scores with a fitted ``spark.ml`` pipeline that reads ``text`` and adds ``probability``.

    Works on rows and puts them together again, so it is for bounded data. ``prepare`` is
    what the text went through before training.
    """

    model: Transformer
    positive: int = 1
    prepare: Callable[[Column], Column] = ascii_lower

    def score_rows(self, df: DataFrame, text: str = "text", into: str = "score") -> DataFrame:
        """One text per row. The model's own columns are dropped."""
        given = df.withColumn("_original", F.col(text)).withColumn("text", self.prepare(F.col(text)))
        kept = [F.col("_original").alias(c) if c == text else F.col(c) for c in df.columns]
        scored = self.model.transform(given)
        return scored.select(*kept, vector_to_array("probability")[self.positive].alias(into))

    def attach(self, df: DataFrame, texts: str, into: str) -> DataFrame:
        def by_row(rows: DataFrame) -> DataFrame:
            given = rows.withColumn("_given", F.coalesce("_text", F.lit("")))
            scored = self.score_rows(given, "_given", "_score")
            payload = F.struct(
                F.col("_score").alias("score"),
                F.lit(None).cast("map<string,double>").alias("detail"),
            )
            return scored.withColumn("_payload", F.when(F.col("_text").isNotNull(), payload))

        return _score_by_row(df, texts, into, by_row)


def _score_by_row(
    df: DataFrame, texts: str, into: str, score: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Explode the texts, score them as rows, and put the scores back by ``message_id``.

    The key is unique per message, so groups are as small as a message and never hot.
    ``score`` keeps every row; a text without a score has a NULL payload.
    """
    rows = df.select("message_id", F.posexplode(texts).alias("_pos", "_text"))
    scored = score(rows).select("message_id", "_pos", "_payload")
    in_order = F.sort_array(F.collect_list(F.struct("_pos", F.to_json("_payload").alias("_json"))))
    lists = scored.groupBy("message_id").agg(in_order.alias("_found"))
    payload = F.transform("_found", lambda f: F.from_json(f["_json"], SCORE))
    none = F.when(F.size(texts) == 0, F.array().cast(T.ArrayType(SCORE)))
    return (
        df.join(lists, "message_id", "left")
        .withColumn(into, F.coalesce(payload, none))
        .drop("_found")
    )


_SCORERS: dict[str, Callable[..., Scorer]] = {
    "lexicon": LexiconScorer,
    "attributes": AttributeTableScorer,
    "pandas": PandasScorer,
    "linear": LinearTextScorer.from_model,
    "sparkml": SparkMLScorer,
}


def register_scorer(name: str, make: Callable[..., Scorer]) -> None:
    """Make a scorer available by name. Ship its code with ``SparkContext.addPyFile``."""
    _SCORERS[name] = make


def by_path(path: str) -> Callable:
    """What ``module:name`` names. The module has to be importable where it is used: see ``addPyFile``."""
    module, colon, name = path.partition(":")
    if not (module and colon and name):
        raise ValueError(f"not of the form module:name: {path!r}")
    return getattr(import_module(module), name)


def scorer(name: str, **options) -> Scorer:
    """The scorer of that name; ``module:name`` makes one by a function or class of one's own."""
    if ":" in name:
        return by_path(name)(**options)
    if name not in _SCORERS:
        raise ValueError(f"unknown scorer {name!r}; known: {sorted(_SCORERS)}")
    return _SCORERS[name](**options)


def analysis_request(text: Column) -> Column:
    """The JSON request that an attribute scoring service takes for one text."""
    wanted = F.struct(*[F.from_json(F.lit("{}"), "struct<>").alias(a) for a in probability.ATTRIBUTES])
    return F.to_json(F.struct(F.struct(text.alias("text")).alias("comment"), wanted.alias("requestedAttributes")))
