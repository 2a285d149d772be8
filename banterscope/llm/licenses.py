"""Licence notices in texts: a trained classifier of passages, with DataFrame functions only on the way of the data.

A passage is a line, a sentence of a line, or, as notices are often wrapped, a run of words across the lines of a
paragraph (lines up to one without words). Runs overlap by half, and a half is longer than any notice, so that
each notice stands whole in one of them. A passage is its words and runs of two and three words. A logistic
regression with an L1 penalty over these n-grams, trained here on the notices below, pieces and altered forms of
them, and on a bounded sample of the corpus as the unknown class, weighs each family against the unknown class,
which is calibrated on altered forms that training has not seen. Every family that is likelier than unknown is
confirmed by comparing the passage with the family's notices: enough words of one notice, and enough of its pairs
of neighbouring words, must be there.

A passage can name several families. One whose found words are all among those found of larger notices, in the
same place, is a part of those ("CC BY" in "CC BY-NC") and goes.

Every weighted n-gram has a word that the sample hardly has, so only passages with such a word are looked at
further; the others are unknown for certain. The weights are a small table, as large as the notices make it,
whatever the corpus.

Cases: null and empty texts have no notices. Rows that repeat come out once for each row; null keys are kept. A
wrapped notice has the number of the line where its passage begins, once for a paragraph and family.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banterscope.session import materialise

UNKNOWN = "unknown"
# Bound of the corpus sample for the unknown class, in paragraphs; and the least probability and share of a notice.
SAMPLE = 800
SAMPLE_CHARS = 600
LEAST = 0.5
CONFIRM = 0.6
# And the least share of its pairs of neighbouring words: in a long passage its words may stand apart by chance.
PAIRS = 0.5

# Usual notices of each family, from the licences' own texts.
NOTICES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Use of this source code is governed by a BSD-style license.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc_by_nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc_by_sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc_by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "public_domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.",
    ),
}
# Lines about licences that name none: they teach the unknown class.
OTHERS = (
    "All rights reserved.", "Copyright 2020 by the author.", "See the license file.", "Licensed under", "the license", "this work is", "free software",
    "Please read the terms of the license before use.", "She renewed her driving license.", "The general public was invited.", "version 2.0", "version 3",
    "This program is great.", "Permission was granted by the editor.", "You may not use this file.", "The software is distributed in boxes.", "public domain",
    "released under pressure", "source code", "free of charge", "the university of california at berkeley", "creative work of the commons",
)


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def ngrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


@dataclass(frozen=True)
class LicenseModel:
    """Families with the unknown class first, the words of which a notice has one, each n-gram's weights, the intercepts."""

    families: tuple[str, ...]
    cues: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    offsets: tuple[float, ...]


def _altered(words: list[str], random: np.random.Generator, filler: list[str]) -> list[str]:
    kept = [w for w in words if random.random() > 0.12] or words
    around = [str(filler[i]) for i in random.integers(0, len(filler), int(random.integers(0, 12)))] if filler else []
    cut = int(random.integers(0, len(around) + 1))
    return around[:cut] + kept + around[cut:]


def train(corpus: list[str], rounds: int = 400, penalty: float = 2e-4) -> LicenseModel:
    """Proximal gradient descent; then intercepts of the families are lowered until altered unknowns stay unknown."""
    random = np.random.default_rng(11)
    families = (UNKNOWN, *NOTICES)
    notices = {f: [words_of(t) for t in NOTICES[f]] for f in families[1:]}
    known = {tuple(w) for ws in notices.values() for w in ws}
    # Lines of the sample that are notices themselves are no examples of the unknown class.
    plain = [w for t in sorted(corpus) if (w := words_of(t)) and not any(set(k) <= set(w) for k in known)]
    filler = [w for ws in plain[:200] for w in ws[:20]]
    data = [(w, 0) for w in plain] + [(words_of(t), 0) for t in OTHERS for _ in range(4)]
    held = []
    for f, own in notices.items():
        for w in own:
            data += [(w, families.index(f))] * 4
            data += [(_altered(w, random, filler), families.index(f)) for _ in range(16)]
    for w in plain[:200]:
        held.append(_altered(w, random, filler))
    # Every n-gram has a word that the sample hardly has, so a line without such a word is unknown for certain.
    lines = Counter(w for ws in plain for w in set(ws))
    often = {w for w, n in lines.items() if 100 * n > len(plain)}
    names = sorted(g for g in set().union(*(ngrams(w) for ws in notices.values() for w in ws)) if not often.issuperset(g.split(" ")))
    place = {n: i for i, n in enumerate(names)}

    def rows(texts: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(texts), len(names) + 1))
        out[:, -1] = 1
        for i, w in enumerate(texts):
            out[i, [place[n] for n in ngrams(w) if n in place]] = 1
        return out

    x, y = rows([w for w, _ in data]), np.array([k for _, k in data])
    target = np.eye(len(families))[y]
    share = np.bincount(y, minlength=len(families))
    weight = (len(y) / len(families) / np.maximum(share, 1))[y][:, None] / len(y)
    beta, look, speed = np.zeros((x.shape[1], len(families))), np.zeros((x.shape[1], len(families))), 1.0
    step = 1 / (0.5 * np.linalg.norm(x * np.sqrt(weight), 2) ** 2)
    for _ in range(rounds):
        z = x @ look
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = look - step * (x.T @ (weight * (p - target)))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        look, beta, speed = new + (speed - 1) / faster * (new - beta), new, faster
    if held:  # calibration: the unknown class wins on altered unknown lines by a margin
        z = rows(held) @ beta
        short = np.quantile(z[:, 1:].max(1) - z[:, 0], 0.999)
        beta[-1, 0] += max(0.0, float(short) + 2.0)
    used = np.flatnonzero(np.abs(beta[:-1]).max(1) > 1e-9)
    cues = {w for i in used for w in names[i].split(" ")} - often
    return LicenseModel(families, tuple(sorted(cues)), {names[i]: tuple(map(float, beta[i])) for i in used}, tuple(map(float, beta[-1])))


def fit(docs: DataFrame, text: str = "text") -> LicenseModel:
    """Train with about ``SAMPLE`` paragraphs of the corpus, chosen by a hash of the text, as the unknown class."""
    count = docs.count()
    chance = F.pmod(F.xxhash64(F.lit("licence"), F.col(text)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = docs.where(F.col(text).isNotNull() & (chance < float(SAMPLE) / max(count, 1)))
    lines = F.split(F.col(text), "\n")
    line = F.element_at(lines, (F.pmod(F.xxhash64(text), F.size(lines)) + 1).cast("int"))
    some = some.select(line.alias("line"))
    # Of a long line, so many characters from a place that its hash chooses.
    place = F.pmod(F.xxhash64("line"), F.greatest(F.length("line") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    return train([r[0] for r in some.select(F.substring("line", place, F.lit(SAMPLE_CHARS))).collect()])


# Longer than any notice, with room for words put in.
HALF = max(len(words_of(t)) for ts in NOTICES.values() for t in ts) * 5 // 4


def _passages(body: DataFrame) -> DataFrame:
    """``key, row, block, line, whole, start, stop, words`` of all lines, sentences and overlapping runs of words."""
    split = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    lines = body.withColumn("lines", F.split("body", "\n"))
    said = lambda i: F.get("lines", i).rlike("[A-Za-z0-9]")
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: said(i) & ((i == 0) | ~said(i - 1)))
    blocks = lines.withColumn("starts", starts).select("key", "row", "lines", "starts", F.posexplode("starts").alias("_at", "block"))
    until = F.coalesce(F.get("starts", F.col("_at") + 1), F.size("lines"))
    blocks = blocks.select("key", "row", "block", F.slice("lines", F.col("block") + 1, until - F.col("block")).alias("lines"))

    def line_tokens(line, i):
        pieces = F.split(line, r"(?<=[.;!?])\s+")
        return F.flatten(F.transform(pieces, lambda p, k: F.transform(split(p), lambda w: F.struct(w.alias("w"), (F.col("block") + i).alias("line"), k.alias("piece")))))

    tokens = blocks.select("key", "row", "block", F.flatten(F.transform("lines", line_tokens)).alias("tokens")).withColumn("n", F.size("tokens"))
    token = lambda i: F.get("tokens", i)
    every = F.sequence(F.lit(0), F.col("n") - 1)
    line_starts = F.filter(every, lambda i: (i == 0) | (token(i)["line"] != token(i - 1)["line"]))
    piece_starts = F.filter(every, lambda i: (i == 0) | (token(i)["line"] != token(i - 1)["line"]) | (token(i)["piece"] != token(i - 1)["piece"]))
    placed = tokens.withColumn("by_line", line_starts).withColumn("by_piece", piece_starts)

    def spans(name: str, whole: bool):
        return F.transform(name, lambda s, k: F.struct(F.lit(whole).alias("whole"), s.alias("start"), F.coalesce(F.get(name, k + 1), F.col("n")).alias("stop")))

    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("n") - HALF - 1, F.lit(0)), F.lit(HALF)),
        lambda s: F.struct(F.lit(False).alias("whole"), s.alias("start"), F.least(s + 2 * HALF, F.col("n")).alias("stop")),
    )
    units = placed.select("key", "row", "block", "tokens", F.explode(F.concat(spans("by_line", True), spans("by_piece", False), runs)).alias("u"))
    words = F.slice("tokens", F.col("u.start") + 1, F.col("u.stop") - F.col("u.start"))["w"]
    return units.select("key", "row", "block", F.get("tokens", F.col("u.start"))["line"].alias("line"), "u.*", words.alias("words"))


def notices(docs: DataFrame, model: LicenseModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, paragraph, family, score, share`` of every licence notice (``paragraph``: its first line, from 0)."""
    spark = docs.sparkSession
    cues = F.array(*map(F.lit, model.cues)).cast("array<string>")
    body = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    # Whole texts without a cue go first; then passages, of the few texts that are left. A row is known by its key, a
    # hash of its text and how often it occurs, so a task that runs anew finds the same rows.
    body = body.where(F.arrays_overlap(F.split(F.lower("body"), "[^a-z0-9]+"), cues)).groupBy("key", "body").agg(F.count("*").alias("n"))
    body = body.select("key", F.struct(F.xxhash64("body").alias("tag"), "n").alias("row"), "body")
    told = _passages(body).where(F.arrays_overlap("words", cues))
    size = F.size("words")

    def runs(n: int):
        return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.array_join(F.slice("words", i, n), " "))).otherwise(F.array().cast("array<string>"))

    place = ["key", "row", "block", "line", "whole", "start", "stop"]
    grams = told.withColumn("gram", F.explode(F.array_distinct(F.concat(runs(1), runs(2), runs(3)))))
    table = spark.createDataFrame([(n, list(w)) for n, w in sorted(model.weights.items())], "gram string, weight array<double>")
    sums = [F.sum(F.col("weight")[i]).alias(f"w{i}") for i in range(len(model.families))]
    # As large as the notices make it, so it may go to every task.
    scored = grams.join(F.broadcast(table), "gram").groupBy(*place).agg(F.any_value("words").alias("words"), *sums)
    z = [F.col(f"w{i}") + F.lit(o) for i, o in enumerate(model.offsets)]
    # Each family against the unknown class.
    odds = F.array(*(F.struct(F.lit(f).alias("family"), (1 / (1 + F.exp(z[0] - z[i]))).alias("score")) for i, f in enumerate(model.families) if i))
    likely = scored.select(*place, "words", runs(2).alias("pairs"), F.inline(odds)).where(F.col("score") >= LEAST)
    own_pairs = lambda w: sorted({" ".join(p) for p in zip(w, w[1:])})
    table = [(f, [(sorted(set(words_of(t))), own_pairs(words_of(t))) for t in ts]) for f, ts in NOTICES.items()]
    templates = spark.createDataFrame(table, "family string, notices array<struct<words: array<string>, pairs: array<string>>>")
    compared = likely.join(F.broadcast(templates), "family")
    close = F.filter("notices", lambda n: F.size(F.array_intersect(n["pairs"], F.col("pairs"))) >= PAIRS * F.size(n["pairs"]))

    def share(n):
        common = F.array_intersect(n["words"], F.col("words"))
        return F.struct((F.size(common) / F.size(n["words"])).alias("share"), F.size(common).alias("n"), common.alias("common"))

    shares = F.array_max(F.transform(close, share))
    # The words found of the nearest notice, and of any of the family's notices.
    common = F.array_intersect(F.array_distinct(F.flatten(F.col("notices")["words"])), F.col("words")).alias("all")
    best = compared.withColumn("s", shares).where(F.col("s.share") >= CONFIRM).select(*place, "family", "score", "s.share", "s.common", common)

    def covered(where):
        """Whether all words found of a family are among those of others of which more was found."""

        def above(o):
            more = (F.size(o["common"]) > F.size("common")) | ((F.size(o["common"]) == F.size("common")) & (o["score"] > F.col("score")))
            return (o["family"] != F.col("family")) & more & where(o)

        theirs = F.flatten(F.transform(F.filter("others", above), lambda o: o["all"]))
        return F.size(F.array_except("common", theirs)) == 0

    here = best.groupBy(*place).agg(F.collect_list(F.struct("family", "score", "share", "common", "all")).alias("others"))
    best = materialise(here.select("*", F.inline("others")).where(~covered(lambda o: F.lit(True))).drop("others"), "passages")
    # A passage may cut a notice: the same for families whose places all meet it. One entry a family.
    group = ["key", "row", "block"]
    each = best.groupBy(*group, "family").agg(
        F.max_by(F.struct("common", "all", "score"), F.size("common")).alias("b"), F.min("stop").alias("stop"), F.max("start").alias("start")
    )
    others = each.groupBy(*group).agg(F.collect_list(F.struct("family", "b.common", "b.all", "b.score", "start", "stop")).alias("others"))
    meets = lambda o: (o["stop"] > F.col("start")) & (o["start"] < F.col("stop"))
    others = others.select(*(F.col(c).alias(f"_{c}") for c in group), "others")
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("row") == F.col("_row")) & (F.col("block") == F.col("_block"))
    own = best.join(others, same).where(~covered(meets)).drop("others", "common", "all")
    # Lines that are notices by themselves come out each; otherwise the best passage of the paragraph does.
    rest = F.struct("share", "score", -F.col("start"), F.col("line"))
    by_family = own.groupBy(*group, "family").agg(
        F.collect_list(F.when(F.col("whole"), F.struct("line", "score", "share"))).alias("lines"), F.max_by(F.struct("line", "score", "share"), rest).alias("best")
    )
    found = by_family.select("key", "row", "family", F.explode(F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.array("best"))).alias("f"))
    found = found.select("key", "family", F.explode(F.array_repeat("f", F.col("row.n").cast("int"))).alias("f"))
    return found.select(F.col("key").alias(key), F.col("f.line").alias("paragraph"), "family", "f.score", "f.share")
