"""Every stage against brute force over what the stage before has kept."""

import re

import corpus_pipeline
import pyarrow as pa
from llm.odd import documents, empty
from llm.test_pairs import brute
from llm.test_spans import secret_spans
from tokenizers import Tokenizer

from banterscope.llm.queries import vocabulary
from banterscope.session import BATCHES, materialise, small_batches


def runs(text, width=5):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    items = [runs(r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "decontamination", "secrets", "encode"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = materialise(stage(spark, docs, tables), "stage")
        after = out.collect()
        if name == "language":
            assert len(after) >= 0.99 * len([r for r in before if re.search(r"[^\W\d_]", r.text)])
        elif name == "near_copies":
            keep = {c for _, _, c in brute([(r.doc_id, r.text) for r in before], 5, 80, 100)}
            assert {r.doc_id for r in after} == keep
        elif name == "decontamination":
            leaks = {r.doc_id for r in before if any(len(i & runs(r.text)) * 100 >= 80 * len(i) for i in items if i)}
            assert leaks and {r.doc_id for r in after} == {r.doc_id for r in before} - leaks
        elif name == "secrets":
            assert len(after) == len(before) and not any(secret_spans(r.text) for r in after)
            same = {r.doc_id: r.text for r in before}
            assert all(r.text == same[r.doc_id] for r in after if not secret_spans(same[r.doc_id]) and "[SECRET]" not in r.text)
            assert all(r.n_chars == len(r.text) for r in after)
        else:
            library = Tokenizer.from_file(vocabulary())
            texts = {r.doc_id: r.text for r in before}
            assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in after)
        if name != "encode":
            assert out.columns == columns
        docs = out


def test_stages_take_odd_rows_and_empty_tables(spark, tables):
    for rows in (documents(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, tables)
            assert out.count() <= rows.count()
            if name != "encode":
                assert out.columns == rows.columns


def test_stages_work_in_small_batches(spark, tables):
    before = {key: spark.conf.get(key) for key in BATCHES}

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    def sizes():
        return [r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(rows, "n long").collect()]

    try:
        for key in BATCHES:
            spark.conf.set(key, "4096")
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, empty(spark), tables)
        assert max(sizes()) <= 1000 and sum(sizes()) == 5000
        assert all(int(spark.conf.get(key)) == most for key, most in BATCHES.items())
        for key in BATCHES:  # a session's own smaller number stays
            spark.conf.set(key, "64")
        small_batches(spark)
        assert max(sizes()) == 64
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
