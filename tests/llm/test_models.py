"""Language and quality: held-out accuracy on the given tables, and odd rows."""

import random

import zstandard
from llm.odd import TEXTS, documents, empty

from banterscope.llm import language, licenses, quality
from banterscope.llm.queries import op2_language, op3_quality, table


def test_held_out_languages(spark, tables):
    rows = op2_language(spark, tables).where("held_out").join(table(spark, tables, "documents"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows_have_a_language(spark):
    model = language.train(["the and of", "le la les de"] * 20, ["en", "fr"] * 20, rounds=2)
    rows = language.predict(documents(spark), model).collect()
    assert len(rows) == len(TEXTS)
    blank = [r for r in rows if r.doc_id in (2, 3, 4)]
    assert [(r.lang_pred, r.score) for r in blank] == [("und", 0.0)] * 3
    assert {r.lang_pred for r in rows if r.doc_id == 5} < {"en", "fr"}
    kept = language.keep_known(documents(spark), model, least=0.0)
    assert kept.columns == documents(spark).columns and kept.count() == len(TEXTS) - 4
    assert language.fit(empty(spark)) is None
    assert {r.lang_pred for r in language.predict(documents(spark), None).collect()} == {"und"}


def test_held_out_quality(spark, tables):
    tables = tables.replace("sf0.001", "sf0.01")  # the smallest one holds out three bad texts only
    rows = op3_quality(spark, tables).where("held_out").join(table(spark, tables, "labels"), "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    better = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert better >= 0.9 * len(good) * len(bad)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)


def test_odd_rows_have_a_quality(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (5, None)], "doc_id long, quality int")
    rows = quality.score(documents(spark), quality.fit(documents(spark), labels)).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    none = quality.fit(empty(spark), labels.limit(0))
    assert quality.score(empty(spark), none).count() == 0


def test_licence_notices(spark):
    rows = [(1, "Some words.\nThis work is licensed under the GNU General Public License, version 3.\nMore."), (2, "Released under the MIT License."), (3, "the license of the driver"), (4, None), (5, ""), (None, "Licensed under CC BY-NC 4.0."), (2, "Released under the MIT License.")]
    model = licenses.train(["here is a plain line of the corpus number %d with words" % i for i in range(60)])
    found = licenses.notices(documents(spark, rows), model).collect()
    assert sorted((r.doc_id or 0, r.paragraph, r.family) for r in found) == [(0, 0, "cc_by_nc"), (1, 1, "gpl"), (2, 0, "mit"), (2, 0, "mit")]
    assert licenses.notices(empty(spark), model).count() == 0


MIT = """/* MIT License
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 */"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License"""


def test_wrapped_notices_and_several_in_one_line(spark):
    plain = "here is a plain line of the corpus with words "
    rows = [(1, MIT), (2, BSD), (3, f"{plain}\n{plain}\n\n{GPL}\n\n{plain}"), (4, f"{plain * 40}{' '.join(GPL.split())} {plain * 40}"), (5, plain)]
    rows += [(6, "Released under the MIT License. Licensed under CC BY-NC 4.0."), (7, "SPDX-License-Identifier: MIT SPDX-License-Identifier: Apache-2.0")]
    rows += [(8, "Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0."), (9, "Licensed under CC BY-\nNC 4.0."), (10, "Licensed under the GNU Affero General Public License, version 3.")]
    rows += [(11, "Komm mit der Bahn.\nLicensed under the Apache License, Version 2.0.\nMit Freude.")]
    model = licenses.train(["here is a plain line of the corpus number %d with words" % i for i in range(60)])
    found = licenses.notices(documents(spark, rows), model).collect()
    assert sorted((r.doc_id, r.family) for r in found) == [
        (1, "mit"), (2, "bsd"), (3, "gpl"), (4, "gpl"), (6, "cc_by_nc"), (6, "mit"), (7, "apache"), (7, "mit"), (8, "cc_by"), (8, "cc_by_nc"), (9, "cc_by_nc"), (10, "agpl"), (11, "apache"),
    ]
    assert {r.paragraph for r in found if r.doc_id == 3} == {3}


def test_licences_of_the_tables(spark, tables):
    docs = table(spark, tables, "documents")
    wanted = docs.where("text rlike 'GNU General Public License|CC BY-NC 4.0|MIT License|Apache License'")
    found = licenses.notices(docs, licenses.fit(docs))
    assert {r[0] for r in wanted.select("doc_id").collect()} == {r[0] for r in found.select("doc_id").collect()}


def test_repeated_rows_have_a_notice_each_however_rows_are_dealt(spark):
    line = "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, line), (1, line), (None, line), (None, line), (1, "x\n" + line), (2, "plain")]
    model = licenses.train(["here is a plain line of the corpus number %d with words" % i for i in range(60)])
    for parts in (1, 5):
        found = licenses.notices(documents(spark, rows).repartition(parts), model).collect()
        assert sorted((str(r.doc_id), r.paragraph, r.family) for r in found) == [("1", 0, "gpl"), ("1", 0, "gpl"), ("1", 1, "gpl"), ("None", 0, "gpl"), ("None", 0, "gpl")]


def test_difference_is_that_of_plain_compression():
    good, bad = ([f"{w} text number {i * 7919 % 1000} of some length".encode() for i in range(300)] for w in ("good", "BAD!"))
    model = quality.QualityModel(quality._dictionary(good), quality._dictionary(bad), 1.0, 0.0)
    text = b"".join(good[:20] + bad[:30])

    def size(data):
        own = zstandard.ZstdCompressionDict(data)
        frames = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=own, write_content_size=False, write_dict_id=False)
        return sum(len(frames.compress(text[i : i + quality.PIECE])) for i in range(0, len(text), quality.PIECE))

    assert model.difference(text) == (size(model.bad) - size(model.good)) / len(text)


def test_quality_learns_from_any_part_of_long_texts(spark):
    r = random.Random(5)
    noise = lambda: " ".join(str(r.random()) for _ in range(30))
    word = {1: lambda: r.choice("river stone meadow harvest".split()), 0: lambda: r.choice("$$$ !!! CLICK WIN".split())}
    # Whole texts are marked by words far beyond the first characters.
    rows = [(i, noise() * 8 + " ".join(word[i % 2]() for _ in range(4000))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.fit(documents(spark, rows), labels)
    scored = quality.score(documents(spark, rows), model).collect()
    assert min(x.score for x in scored if x.doc_id % 2) > max(x.score for x in scored if x.doc_id % 2 == 0)
