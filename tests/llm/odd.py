"""Rows that every operator must take: nulls, empty and long texts, repeats, ties, and clashing columns."""

LONG = "word " * 30_000 + "x" * 50_000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, LONG),
    (5, LONG),
    (6, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (None, "no key here, but a text of some words all the same"),
    (None, None),
    (7, "¿Qué? ünïcödé 你好 😀 12345 !!!"),
    (8, "one"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, tag string, ids string, leaf string, secrets string, id string, html string"


def documents(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["own"] * 7) for i, t in rows], SCHEMA)


def empty(spark):
    return documents(spark, [])


def malformed(spark):
    """Two tables: one has texts with bytes that are no UTF-8, the other has U+FFFD in their place."""
    broken = "concat('ann@example.com Zyx ', cast(unhex('FF') as string), ' Zyx and ', cast(unhex('C3') as string), ' more ann@example.com')"
    text = f"CASE doc_id WHEN 7 THEN {broken} WHEN 8 THEN concat('<article><p>', {broken}, '</p></article>') ELSE text END"
    given = documents(spark).selectExpr("* EXCEPT (text)", f"{text} AS text")
    plain = "ann@example.com Zyx \ufffd Zyx and \ufffd more ann@example.com"
    changed = {7: plain, 8: f"<article><p>{plain}</p></article>"}
    return given, documents(spark, [(i, changed.get(i, t)) for i, t in TEXTS])
