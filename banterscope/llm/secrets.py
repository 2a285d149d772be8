"""Secrets in texts by a trigram index, with DataFrame functions only.

From each rule's pattern a Boolean query over trigrams is derived: every part that spells out letters gives a
clause, an OR over its spellings, each of them the AND of its trigrams. The index keeps, for the trigrams of all
queries, which texts (in lower case) have them; postings are joined with the queries' terms and counted, so that
only texts that satisfy all clauses of a rule are candidates for it. Candidates are verified by the pattern.
A rule whose pattern spells out no three letters in a row has no query and scans every text.

Positions count code points and end before the last one. Matches are the leftmost ones that don't overlap, per
rule; those that are too short are dropped afterwards.

Cases: null texts count as empty and have no secrets. Rows that repeat or have a null key come out as they are,
each with its own result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length is looked at, and its least length.

    ``scan`` may give a pattern that has the same long matches but not the short ones.
    """

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    scan: str = ""

    @property
    def used(self) -> str:
        return self.scan or self.pattern


# The base rules in the order in which they are listed, then the added ones.
BASE = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # A match is a whole run of these characters, so runs of at least 16 are just its long matches.
    Rule("hex", r"[0-9a-f]+", 0, 16, scan=r"[0-9a-f]{16,}"),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE + ADDED

# A part with more spellings is cut in two there; this weakens its clause and loses nothing.
MOST_SPELLINGS = 64

Clause = frozenset[frozenset[str]]


def _parts(parsed) -> list[set[str] | None]:
    """The pattern as a sequence: the spellings of each part, None where anything may stand."""
    out: list[set[str] | None] = []
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            out.append({chr(value)})
        elif name == "IN":
            letters = [chr(v) for kind, v in value if str(kind) == "LITERAL"]
            out.append(set(letters) if len(letters) == len(value) else None)
        elif name == "SUBPATTERN":
            out += _parts(value[-1])
        elif name == "BRANCH":
            choices = [_whole(_parts(p)) for p in value[1]]
            out.append(None if None in choices else set().union(*choices))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = value
            once = _parts(inner)
            if high == 1 and low == 0:
                whole = _whole(once)
                out.append(None if whole is None else whole | {""})
            elif low == high and low * len(once) <= 16:
                out += once * low
            else:
                out += (once if low else []) + [None]
        elif name != "AT":
            out.append(None)
    return out


def _whole(parts: list[set[str] | None]) -> set[str] | None:
    """All spellings of a sequence, or None if they can't be listed."""
    out = {""}
    for p in parts:
        if p is None or len(out) * len(p) > MOST_SPELLINGS:
            return None
        out = {a + b for a, b in product(out, p)}
    return out


def trigram_query(pattern: str) -> list[Clause]:
    """The clauses, all of which a text in lower case must satisfy for the pattern to match; none: scan it."""
    parts = _parts(re._parser.parse(pattern)) + [None]
    runs, now = [], {""}
    for p in parts:
        if p is not None and len(now) * len(p) <= MOST_SPELLINGS:
            now = {a + b for a, b in product(now, p)}
            continue
        runs.append(now)
        now = p or {""}
    clauses = []
    for run in [*runs, now]:
        spelled = {frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() in spelled:
            continue  # a spelling without a trigram: no condition
        clauses.append(frozenset(s for s in spelled if not any(o < s for o in spelled)))
    return clauses


def spans(text: Column, rule: Rule) -> Column:
    """``array<struct<start, end>>`` of the rule's matches in a text."""
    found = F.regexp_extract_all(text, F.lit(rule.used), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(rule.used), F.lit(rule.group)) if rule.group else found
    # What stands before each match; the last piece follows the last match.
    pieces = F.split(text, rule.used, -1)
    empty = F.array().cast("array<struct<start: int, end: int, size: int>>")

    def step(done: Column, part: Column) -> Column:
        start = done["at"] + F.length(part["piece"])
        end = start + F.length(part["match"])
        span = F.struct(start.alias("start"), end.alias("end"), F.length(part["value"]).alias("size"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    parts = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("match"), measured.alias("value"))
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    all_spans = F.aggregate(parts, start, step, lambda done: done["spans"])
    return F.transform(F.filter(all_spans, lambda s: s["size"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def candidates(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``_id, _rules``: the rules whose trigram queries the text of each ``_id, _text`` satisfies."""
    queries = {r.name: q for r in rules if (q := trigram_query(r.pattern))}
    terms = [
        (t, name, c, a, len(alternative))
        for name, clauses in sorted(queries.items())
        for c, clause in enumerate(clauses)
        for a, alternative in enumerate(sorted(map(sorted, clause)))
        for t in alternative
    ]
    spark = texts.sparkSession
    # One row a rule, clause, spelling and trigram: its size is the rules', whatever the texts.
    asked = spark.createDataFrame(terms, "trigram string, rule string, clause int, spelling int, need int")
    sizes = spark.createDataFrame([(n, len(q)) for n, q in sorted(queries.items())], "rule string, clauses int")
    listed = F.array(*(F.lit(t) for t in sorted({t[0] for t in terms})))
    low = texts.select("_id", F.lower("_text").alias("_low"))
    postings = low.select("_id", F.explode(F.filter(listed, lambda t: F.contains(F.col("_low"), t))).alias("trigram"))
    # Dealt once by text; everything below groups within that.
    postings = postings.distinct().repartition("_id")
    spelled = postings.join(F.broadcast(asked), "trigram").groupBy("_id", "rule", "clause", "spelling").agg(F.count("*").alias("has"), F.any_value("need").alias("need"))
    clauses = spelled.where("has = need").groupBy("_id", "rule", "clause").agg(F.lit(1).alias("one"))
    whole = clauses.groupBy("_id", "rule").agg(F.count("*").alias("has")).join(F.broadcast(sizes), "rule").where("has = clauses")
    return whole.groupBy("_id").agg(F.collect_set("rule").alias("_rules"))


def _named(order: int, name: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(name).alias("kind"))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns to ``keep``, and ``secrets array<struct<kind, start, end>>`` by start, then rule as listed.

    Rows are known by a hash of key and text. Where two rows share one they share candidates, which only means
    that more is verified.
    """
    plain = docs.select(key, *keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    plain = plain.withColumn("_id", F.xxhash64(key, "_text"))
    found = plain.join(candidates(plain.select("_id", "_text"), rules), "_id", "left")
    lists = []
    for order, rule in enumerate(rules):
        if trigram_query(rule.pattern):
            try_it = F.array_contains(F.coalesce("_rules", F.array().cast("array<string>")), rule.name)
        else:
            try_it = F.col("_text").rlike(rule.used)
        named = F.transform(spans(F.col("_text"), rule), _named(order, rule.name))
        lists.append(F.when(try_it, named).otherwise(F.array().cast("array<struct<start: int, order: int, end: int, kind: string>>")))
    ordered = F.sort_array(F.concat(*lists))
    out = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(key, *keep, out.alias("secrets"))


def listed(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in its texts replaced by a mark; overlapping ones get one mark together."""
    # The row travels packed, so that its columns may have any names.
    packed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.struct("*").alias("row"))
    body = F.coalesce(F.col("row")[text], F.lit(""))

    def step(done: Column, s: Column) -> Column:
        gap = F.substr(body, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        fresh = F.when(s["start"] >= done["at"], F.concat(gap, F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["out"], fresh).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("secrets", start, step, lambda done: F.concat(done["out"], F.substr(body, done["at"] + 1, F.length(body))))
    found = scanned(packed, "key", "text", keep=("row",))
    changed = F.when(F.size("secrets") > 0, clean).otherwise(F.col("row")[text])
    return found.select(*(changed.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
