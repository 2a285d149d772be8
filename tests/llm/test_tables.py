"""Tables that a query writes on its way go when nothing reads them again."""

from banterscope import session
from banterscope.llm import jaccard


def test_used_tables_go_while_the_query_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session.tempfile, "mkdtemp", lambda prefix: str(tmp_path))
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(words[::-1])), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.linked(docs)
    left = {p.name.split("-")[0] for p in tmp_path.iterdir()}
    assert left.isdisjoint({"slots", "leaves", "tokens", "shows", "stars", "known", "pairs", "tags", "sets", "inner", "tree", "nodes"})
    assert sorted(map(tuple, found.collect())) == [(1, 57, 1), (2, 57, 1), (3, 57, 3), (4, 0, 4)]
