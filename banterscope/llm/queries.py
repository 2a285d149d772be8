"""The operators over the given tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banterscope.llm import bpe, fingerprints, html, jaccard, language, leaks, licenses, manifest, negatives, pieces, private, quality, secrets
from banterscope.llm.samples import fold
from banterscope.session import small_batches


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def piece_vocabulary() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    coded = bpe.encode(table(spark, folder, "documents"), vocabulary(), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document; learned from the other four folds."""
    docs = table(spark, folder, "documents")
    model = language.fit(docs.where(fold("doc_id", 5) != 0))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; learned from the other three folds."""
    docs = table(spark, folder, "documents")
    seen = fold("doc_id", 4) != 2
    model = quality.fit(docs.where(seen), table(spark, folder, "labels").where(seen))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return quality.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the base kinds of secrets, their places, and all places of every document."""
    found = secrets.scanned(table(spark, folder, "documents"))
    base = [rule.name for rule in secrets.BASE]
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(secrets.listed(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        secrets.listed(F.col("secrets")).alias("spans"),
    )


def op6_html(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    found = html.main_text(table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint, its edited form's, and their likeness."""
    return fingerprints.compare_with_next(table(spark, folder, "documents"))


def op10_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document: four words, 85 of 100."""
    small_batches(spark)
    return jaccard.linked(table(spark, folder, "documents"), width=4, share=85, parts=100)


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, item_id, shared, n_item`` of every document with four fifths of an item's five-word runs."""
    found = leaks.contained(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("shared").alias("shared"), F.max("n_item").alias("n_item"))


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, paragraph, family, score, share`` of every licence notice in the documents."""
    docs = table(spark, folder, "documents")
    return licenses.notices(docs, licenses.fit(docs))


def op9_private(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of personal data by kind, its places, and all marked places of every document."""
    rows = private.marked(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    terms = F.transform("terms", lambda s: F.struct(F.lit(private.MARK).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select(
        "doc_id",
        *(count(kind) for kind in private.KINDS),
        F.sha2(private.listed(F.col("base")), 256).alias("base_sha256"),
        private.listed(F.concat("base", terms)).alias("spans"),
    )


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots, proof and what a tampered row leads to, of every document; where 7 divides the CRC-32 of the
    doc_id, the row found has one character more in ``n_chars``."""
    docs = table(spark, folder, "documents")
    told = ["doc_id", "source", "lang", "n_chars", "text"]
    more = F.try_add(F.col("n_chars").cast("long"), F.lit(1).cast("long"))
    found = [more if name == "n_chars" else F.col(name) for name in told]
    return manifest.manifest(docs, "doc_id", "lang", [F.col(name) for name in told], fold("doc_id", 7) == 0, found)


def op12_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    coded = pieces.encode(table(spark, folder, "documents"), piece_vocabulary(), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector: five for each of its five positives, of 80 to 100 hundredths of their score."""
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), anchors=F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_language": op2_language,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_secrets": op5_secrets,
    "op6_html": op6_html,
    "op7_fingerprints": op7_fingerprints,
    "op8_licenses": op8_licenses,
    "op9_private": op9_private,
    "op10_jaccard": op10_jaccard,
    "op11_manifest": op11_manifest,
    "op12_pieces": op12_pieces,
    "op13_negatives": op13_negatives,
}


def _secrets_sql() -> str:
    parts = " UNION ALL ".join(
        f"""
        SELECT doc_id, {order} AS rule, '{rule.name}' AS kind,
          unnest(regexp_extract_all(t, '{rule.pattern.replace("'", "''")}', 0)) AS found,
          unnest(regexp_extract_all(t, '{rule.pattern.replace("'", "''")}', {rule.group})) AS value,
          unnest(regexp_split_to_array(t, '{rule.pattern.replace("'", "''")}')) AS before,
          unnest(range(1, len(regexp_split_to_array(t, '{rule.pattern.replace("'", "''")}')) + 1)) AS i
        FROM texts"""
        for order, rule in enumerate(secrets.RULES)
    )
    least = " ".join(f"WHEN {order} THEN {rule.least}" for order, rule in enumerate(secrets.RULES))
    base = len(secrets.BASE)
    return f"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        parts AS ({parts}),
        placed AS (
          SELECT *, sum(length(before) + coalesce(length(found), 0)) OVER (PARTITION BY doc_id, rule ORDER BY i) AS stop FROM parts),
        spans AS (
          SELECT doc_id, rule, kind, (stop - length(found))::BIGINT AS start, kind || ':' || (stop - length(found))::BIGINT || ':' || stop::BIGINT AS span
          FROM placed WHERE found IS NOT NULL AND length(value) >= CASE rule {least} END)
        SELECT doc_id, count(span) FILTER (kind = 'assign') AS n_assign, count(span) FILTER (kind = 'access') AS n_access,
          count(span) FILTER (kind = 'hex') AS n_hex,
          sha256(coalesce(string_agg(span, ',' ORDER BY start, rule) FILTER (rule < {base}), '')) AS base_sha256,
          coalesce(string_agg(span, ',' ORDER BY start, rule), '') AS spans
        FROM texts LEFT JOIN spans USING (doc_id) GROUP BY doc_id
    """


def _manifest_sql() -> str:
    """The same trees level by level. The CRC-32 of the key runs over the bits of its decimal digits."""
    def leaf(n: str) -> str:
        told = (f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("d.doc_id", "d.source", "d.lang", n, "d.text"))
        return f"sha256({' || '.join(told)})"

    def up(of: str, base: str) -> str:
        return f"""
          SELECT {of}, level + 1 AS level, pos // 2 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, any_value(n + 1) // 2 AS n
          FROM {base} WHERE n > 1 GROUP BY {of}, level, pos // 2"""

    return f"""
        WITH RECURSIVE bytes AS (
          SELECT DISTINCT doc_id, list_concat([4294967295], list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda c: ascii(c)::BIGINT)) AS b FROM documents),
        folds AS (
          SELECT doc_id, xor(list_reduce(b, lambda crc, c: list_reduce(list_concat([xor(crc, c)], [0, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS crc FROM bytes),
        leaves AS (
          SELECT d.doc_id, d.lang, {leaf("d.n_chars")} AS leaf, CASE WHEN crc % 7 = 0 THEN {leaf("(d.n_chars + 1)")} ELSE {leaf("d.n_chars")} END AS found,
            row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
          FROM documents d LEFT JOIN folds ON folds.doc_id = d.doc_id
          WINDOW w AS (PARTITION BY lang ORDER BY d.doc_id NULLS FIRST)),
        tree AS (
          SELECT lang, 0 AS level, pos, leaf AS h, n FROM leaves
          UNION ALL {up("lang", "tree")}),
        subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
        top AS (
          SELECT 0 AS one, 0 AS level, pos, subroot AS h, n FROM subroots
          UNION ALL {up("one", "top")}),
        steps AS (
          SELECT doc_id, lang, leaf, pos AS first, 0 AS step, found AS h, pos, n, '' AS others, false AS above FROM leaves
          UNION ALL
          SELECT p.doc_id, p.lang, p.leaf, p.first, p.step + 1,
            sha256(CASE WHEN s.pos < p.pos THEN s.h ELSE '' END || p.h || CASE WHEN s.pos > p.pos THEN s.h ELSE '' END),
            p.pos // 2, (p.n + 1) // 2, p.others || coalesce(s.h, ''), false
          FROM steps p LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = p.step AND s.pos = xor(p.pos, 1)
          WHERE p.n > 1),
        over AS (
          SELECT s.doc_id, s.lang, s.leaf, s.first, 0 AS step, s.h, r.pos, r.n, s.others, r.subroot
          FROM steps s JOIN subroots r ON r.lang IS NOT DISTINCT FROM s.lang WHERE s.n = 1
          UNION ALL
          SELECT p.doc_id, p.lang, p.leaf, p.first, p.step + 1,
            sha256(CASE WHEN s.pos < p.pos THEN s.h ELSE '' END || p.h || CASE WHEN s.pos > p.pos THEN s.h ELSE '' END),
            p.pos // 2, (p.n + 1) // 2, p.others || coalesce(s.h, ''), p.subroot
          FROM over p LEFT JOIN top s ON s.level = p.step AND s.pos = xor(p.pos, 1)
          WHERE p.n > 1)
        SELECT doc_id, leaf, subroot, root, sha256(others) AS proof_sha256, h AS folded_root, h = root AS verified
        FROM over, (SELECT h AS root FROM top WHERE n = 1) WHERE n = 1
    """


SQL: dict[str, str] = {
    "op11_manifest": _manifest_sql(),
    "op13_negatives": """
        WITH own AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (
          SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
          FROM own a JOIN own c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
        positives AS (
          SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scores USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY rank <= 5
    """,
    "op5_secrets": _secrets_sql(),
    "op4_decontamination": """
        WITH words AS (
          SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM documents
          UNION ALL
          SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{80}-\\x{10FFFF}]+') FROM benchmark),
        widths AS (SELECT DISTINCT least(len(w), 5) AS k FROM words WHERE kind = 'i' AND len(w) > 0),
        runs AS (
          SELECT DISTINCT kind, id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS run
          FROM words JOIN widths ON (kind = 'd' AND len(w) >= k) OR (kind = 'i' AND k = least(len(w), 5))),
        sizes AS (SELECT id, count(*) AS n FROM runs WHERE kind = 'i' GROUP BY id)
        SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared, any_value(n) AS n_item
        FROM runs d JOIN runs i ON d.kind = 'd' AND i.kind = 'i' AND d.k = i.k AND d.run = i.run JOIN sizes s ON s.id = i.id
        GROUP BY d.id, i.id HAVING count(*) * 100 >= any_value(n) * 80
    """,
}
