"""Personal data in texts, and the words that give it away.

Addresses, cards and telephone numbers are found by pattern; each found value is a protected entity. Over the
whole corpus it is then counted in how many different texts a word stands together with an entity, anywhere in
the text, and in how many it stands at all. The share of an entity's information that a word reveals is their
pointwise mutual information by the entity's own information content:

    disclosure(word, entity) = ln(N * both / (word * entity)) / ln(N / entity)

It is 1 if the word occurs with that entity only. Words at or above the threshold for any entity are marked
wherever they stand, also in texts that don't print the value. ``sanitise`` replaces what is marked: values by
their kind, words by a general class, and words that occur with nothing else by nothing.

Entities that stand in exactly the same texts reveal the same, and are counted as one.

Cases: null texts count as empty. Copies of a text count once in the statistics, but each row is marked. An
entity in a single text counts like any other: a word that stands in no other text reveals all of it. Words may
have a single letter. Cards and telephone numbers are the same entity however their digits are parted. Texts
are read whole. Bytes that are no UTF-8 count as U+FFFD, also in places and in sanitised texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banterscope.llm.blocks import BitFilter, WordTable, filter_of, kept, text_blocks
from banterscope.session import materialise

# The kinds, in the order in which they are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile("[0-9]")

THRESHOLD = 0.9
FILTER_LOG = 24
MARK = "term"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """All leftmost matches. Each begins where the run of letters before an at sign begins, or a match ended."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            yield found.span()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of every value, by kind as listed and then by start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = "".join(_DIGITS.findall(m.group()))
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.findall(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity_of(kind: str, value: str) -> str:
    """The same for all spellings of a value."""
    return f"{kind}:{''.join(_DIGITS.findall(value)) if kind in ('card', 'phone') else value.lower()}"


def _free_words(texts: list[bytes], bases: list[list[tuple[str, int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash, start and end, in characters of the text, of all words outside of the text's values."""
    hashes, starts, ends, firsts, joined = kept("alphanumeric words", WordTable.alphanumeric).words(texts)
    # Characters before each byte: every byte that doesn't go on with a character begins one.
    data = np.frombuffer(joined, np.uint8)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    owner = np.repeat(np.arange(len(texts)), np.diff(firsts))
    starts, ends = before[starts], before[ends]
    # Steps up where a value begins and down where it ends: a word that meets none has no step inside, and none open.
    spans = np.array([(before[first[i]] + a, before[first[i]] + b) for i, base in enumerate(bases) for _, a, b in base], np.int64).reshape(-1, 2)
    steps = np.zeros(before[-1] + 2, np.int64)
    np.add.at(steps, spans[:, 0], 1)
    np.add.at(steps, spans[:, 1], -1)
    taken = np.zeros(len(steps) + 1, np.int64)
    np.cumsum(np.cumsum(steps) > 0, out=taken[1:])
    free = taken[starts] == taken[ends]
    own = before[first[owner[free]]]
    return owner[free], hashes[free], starts[free] - own, ends[free] - own


_FOUND = "base array<struct<kind: string, start: int, end: int>>, entities array<string>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def found(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, tag, base, entities`` of every row: the places of its values, and the different values. No shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_blocks(batch, "text"):
                base, entities = [], []
                for t in texts:
                    t = t.decode("utf-8")
                    spans = base_spans(t)
                    base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                    entities.append(sorted({entity_of(k, t[a:b]) for k, a, b in spans}))
                arrays = [rows.column("key"), rows.column("tag"), pa.array(base, _SPAN), pa.array(entities, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "tag", "base", "entities"])

    plain = docs.select(F.col(key).alias("key"), F.make_valid_utf8(text).alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tag"))
    return plain.mapInArrow(run, f"key {kind}, tag long, {_FOUND}").withColumnRenamed("key", key)


def disclosing(docs: DataFrame, rows: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``word, disclosure`` of all words at or above the threshold for an entity; counts are over all different texts."""
    total = rows.select("tag").distinct().count()
    values = rows.where(F.size("entities") > 0).select("tag", F.explode("entities").alias("entity")).distinct()
    # Two sums over the texts tell sets of texts apart.
    sums = [F.sum(F.xxhash64(F.lit(i), "tag").cast("decimal(38, 0)")) for i in range(2)]
    sets = values.groupBy("entity").agg(F.count("*").alias("n_entity"), F.xxhash64(*sums).alias("set"))
    # An entity in every text has no information to reveal.
    information = F.log(F.lit(float(total)) / F.col("n_entity"))
    sets = values.join(sets.where(information > 0), "entity").select("tag", "set", "n_entity").distinct()
    sets = materialise(sets, "sets")

    def revealed(count: str) -> Column:
        return F.log(F.lit(float(total)) * F.col("both") / (F.col(count) * F.col("n_entity"))) / information

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch, "text"):
                bases = [base_spans(t.decode("utf-8")) for t in texts]
                with_values = [i for i, base in enumerate(bases) if base]
                owner, hashes, _, _ = _free_words([texts[i] for i in with_values], [bases[i] for i in with_values])
                pairs = np.unique(np.stack([owner.astype(np.uint64), hashes], 1), axis=0)
                tags = part.column("tag").to_numpy()[with_values][pairs[:, 0].astype(np.int64)] if with_values else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tags), pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))], ["tag", "word"])

    plain = docs.select(F.make_valid_utf8(text).alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tag"))
    # Texts without a value have no words together with one.
    beside = materialise(plain.mapInArrow(occurring, "tag long, word long").distinct(), "beside")
    both = beside.join(sets, "tag").groupBy("set", "word").agg(F.count("*").alias("both"), F.any_value("n_entity").alias("n_entity"))
    # A word stands in at least as many texts as it stands with values in; where that is too many, it reveals too little.
    beside = beside.groupBy("word").agg(F.count("*").alias("n_beside"))
    both = materialise(both.join(beside, "word").where(revealed("n_beside") >= threshold).drop("n_beside"), "both")
    context = docs.sparkSession.sparkContext
    held = context.broadcast(filter_of(both.select("word"), FILTER_LOG).bits.tobytes())
    # Texts that occur more than once are counted by text, all others are summed up within their task.
    again = materialise(rows.groupBy("tag").agg(F.count("*").alias("n")).where("n > 1").select("tag"), "again")
    repeated = context.broadcast(filter_of(again, FILTER_LOG).bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, more, table = BitFilter(held.value), BitFilter(repeated.value), kept("alphanumeric words", WordTable.alphanumeric)
        sums: tuple[np.ndarray, np.ndarray] = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for part, texts in text_blocks(batch, "text"):
                hashes, _, _, firsts, _ = table.words(texts)
                hit = own.has(hashes)
                owner = np.repeat(np.arange(len(texts)), np.diff(firsts))[hit]
                pairs = np.unique(np.stack([owner.astype(np.uint64), hashes[hit]], 1), axis=0)
                tags = part.column("tag").to_numpy()[pairs[:, 0].astype(np.int64)]
                copied = more.has(tags.view(np.uint64))
                yield put(pa.array(tags[copied]), pairs[copied, 1], np.ones(copied.sum(), np.int64))
                words, counts = np.unique(pairs[~copied, 1], return_counts=True)
                words, where = np.unique(np.concatenate([sums[0], words]), return_inverse=True)
                sums = words, np.bincount(where, np.concatenate([sums[1], counts])).astype(np.int64)
                if len(words) > 1 << 20:
                    yield put(pa.nulls(len(words), pa.int64()), *sums)
                    sums = words[:0], sums[1][:0]
        yield put(pa.nulls(len(sums[0]), pa.int64()), *sums)

    def put(tags: pa.Array, words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([tags, pa.array(np.ascontiguousarray(words).view(np.int64)), pa.array(counts)], ["tag", "word", "n"])

    counted = plain.mapInArrow(run, "tag long, word long, n long")
    # Partial sums for the single texts; a copied text counts a word once.
    each = counted.groupBy("word", "tag").agg(F.sum("n").alias("n"))
    words = each.groupBy("word").agg(F.sum(F.when(F.col("tag").isNull(), F.col("n")).otherwise(1)).alias("n_word"))
    scored = both.join(words, "word").withColumn("disclosure", revealed("n_word"))
    return scored.where(F.col("disclosure") >= threshold).groupBy("word").agg(F.max("disclosure").alias("disclosure"))


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key, base, terms`` of every row: the values, and the words that reveal them with their disclosure."""
    rows = materialise(found(docs, key, text), "values")
    words = materialise(disclosing(docs, rows, text, threshold), "words")
    held = docs.sparkSession.sparkContext.broadcast(filter_of(words.select("word"), FILTER_LOG).bits.tobytes())
    kind = docs.schema[key].dataType.simpleString()

    def standing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = BitFilter(held.value), kept("alphanumeric words", WordTable.alphanumeric)
        for batch in batches:
            for part, texts in text_blocks(batch, "text"):
                hashes, _, _, firsts, _ = table.words(texts)
                some = np.unique(np.searchsorted(firsts, np.flatnonzero(own.has(hashes)), "right") - 1)
                picked = [texts[i] for i in some]
                owner, hashes, starts, ends = _free_words(picked, [base_spans(t.decode("utf-8")) for t in picked])
                hit = own.has(hashes)
                rows = part.select(["key", "tag"]).take(pa.array(some[owner[hit]]))
                places = [pa.array(x[hit].astype(np.int32)) for x in (starts, ends)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(hashes[hit].view(np.int64)), *places], ["_key", "_tag", "word", "start", "end"])

    plain = docs.select(F.col(key).alias("key"), F.make_valid_utf8(text).alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tag"))
    places = plain.mapInArrow(standing, f"_key {kind}, _tag long, word long, start int, end int").join(words, "word")
    spans = places.groupBy("_key", "_tag", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    # As many entries as a single text has words.
    spans = spans.groupBy("_key", "_tag").agg(F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))
    joined = rows.join(spans, rows[key].eqNullSafe(spans["_key"]) & (rows["tag"] == spans["_tag"]), "left")
    return joined.select(key, "tag", "base", F.coalesce("terms", F.array().cast("array<struct<start: int, end: int, disclosure: double>>")).alias("terms"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key, sanitised`` of every row: its text with all that is marked replaced."""
    spans = marked(docs, key, text, threshold).select(F.col(key).alias("_key"), F.col("tag").alias("_tag"), "base", "terms").distinct()
    joined = docs.select(key, text).join(spans, F.col(key).eqNullSafe(F.col("_key")) & (F.coalesce(F.xxhash64(text), F.lit(0)) == F.col("_tag")), "left")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, base, terms in zip(*(batch.column(c).to_pylist() for c in ("text", "base", "terms")), strict=True):
                t = t or ""
                edits = [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in base or []]
                edits += [(s["start"], s["end"], "" if s["disclosure"] >= 1 else "[NUMBER]" if t[s["start"] : s["end"]].isdigit() else "[WORD]") for s in terms or []]
                at, pieces = 0, []
                for a, b, new in sorted(edits):
                    if a >= at:
                        pieces += [t[at:a], new]
                    at = max(at, b)
                out.append("".join(pieces) + t[at:])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.string())], ["key", "sanitised"])

    plain = joined.select(F.col(key).alias("key"), F.make_valid_utf8(text).alias("text"), "base", "terms")
    return plain.mapInArrow(run, f"key {kind}, sanitised string").withColumnRenamed("key", key)
