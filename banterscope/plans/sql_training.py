"""SQL for the training-data and model queries. Models that are fitted have none."""

from banterscope.plans.sql_chat import SCORED_DOCUMENTS

_STATS = """
SELECT 'event_id' AS feature, 'INT' AS type, count(*) AS examples, count(*) - count(event_id) AS missing,
       min(event_id)::DOUBLE AS min, max(event_id)::DOUBLE AS max, avg(event_id) AS mean,
       stddev_pop(event_id) AS std, count(*) FILTER (event_id = 0) AS zeros, NULL::DOUBLE AS avg_length FROM events
UNION ALL
SELECT 'user_id', 'INT', count(*), count(*) - count(user_id), min(user_id), max(user_id), avg(user_id),
       stddev_pop(user_id), count(*) FILTER (user_id = 0), NULL FROM events
UNION ALL
SELECT 'value', 'FLOAT', count(*), count(*) - count(value), min(value), max(value), avg(value),
       stddev_pop(value), count(*) FILTER (value = 0), NULL FROM events
UNION ALL
SELECT 'ts', 'OTHER', count(*), count(*) - count(ts), NULL, NULL, NULL, NULL, NULL, NULL FROM events
UNION ALL
SELECT 'event_type', 'BYTES', count(*), count(*) - count(event_type), NULL, NULL, NULL, NULL, NULL,
       avg(len(event_type)) FROM events
UNION ALL
SELECT 'props', 'BYTES', count(*), count(*) - count(props), NULL, NULL, NULL, NULL, NULL,
       avg(len(props)) FROM events"""

_COUNTS = """
SELECT 'event_type' AS feature, event_type AS value, count(*) AS n FROM events GROUP BY event_type
UNION ALL
SELECT 'props', props, count(*) FROM events GROUP BY props"""

_RANKED = f"""
SELECT feature, value, n, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rank,
       count(*) OVER (PARTITION BY feature) AS size
FROM ({_COUNTS})"""

_PREDICTIONS = f"""
{SCORED_DOCUMENTS},
predicted AS (SELECT s.score, l.toxic::DOUBLE AS label FROM scored s JOIN labels l USING (doc_id))"""

SQL = {
    "training_source": """
SELECT toxic AS target, count(*) AS examples FROM documents JOIN labels USING (doc_id) GROUP BY toxic
""",
    "train_split": """
SELECT doc_id,
       CASE WHEN ('0x' || substr(md5('25:' || doc_id), 1, 8))::BIGINT % 100 < 80
            THEN 'train' ELSE 'test' END AS side
FROM documents
""",
    "ratio_split": """
SELECT doc_id,
       CASE WHEN ('0x' || substr(md5('25:' || doc_id), 1, 8))::BIGINT % 3 < 2
            THEN 'train' ELSE 'eval' END AS side
FROM documents
""",
    "truncate_text": "SELECT doc_id, substr(text, 1, 511) AS text FROM documents",
    "preprocess_features": """
SELECT doc_id, toxic AS label,
       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
FROM documents JOIN labels USING (doc_id)
""",
    "embedding_attach": """
SELECT doc_id, len(t)::DOUBLE AS length, (len(t) - len(replace(t, ' ', '')))::DOUBLE AS blanks,
       (len(t) - len(replace(t, chr(10), '')))::DOUBLE AS lines
FROM (SELECT doc_id, text AS t FROM documents)
""",
    "dataset_stats": f"""
WITH stats AS ({_STATS}), ranked AS ({_RANKED})
SELECT s.feature, type, examples, missing, round(min, 4) AS min, round(max, 4) AS max, round(mean, 4) AS mean,
       round(std, 4) AS std, zeros, round(avg_length, 4) AS avg_length,
       r.size AS distinct_values, r.n AS top_count, r.value AS top_value
FROM stats s LEFT JOIN ranked r ON r.feature = s.feature AND r.rank = 1
""",
    "dataset_top_values": f"""
SELECT feature, value, n AS "count", rank FROM ({_RANKED}) WHERE rank <= 10
""",
    "dataset_quantiles": """
WITH long AS (
  SELECT 'event_id' AS feature, event_id::DOUBLE AS v FROM events WHERE event_id IS NOT NULL
  UNION ALL SELECT 'user_id', user_id::DOUBLE FROM events WHERE user_id IS NOT NULL
  UNION ALL SELECT 'value', value::DOUBLE FROM events WHERE value IS NOT NULL
), placed AS (
  SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) AS place, count(*) OVER (PARTITION BY feature) AS n FROM long
)
SELECT feature, i / 4.0::DOUBLE AS share, v AS value
FROM placed, (SELECT unnest([0, 1, 2, 3, 4]) AS i) AS shares
WHERE place = greatest(1, (i * n + 3) // 4)
""",
    "infer_schema": f"""
WITH stats AS ({_STATS}), sizes AS (SELECT feature, count(*) AS size FROM ({_COUNTS}) GROUP BY feature)
SELECT s.feature, s.type, (s.missing = 0)::INTEGER AS required,
       z.size AS domain_size
FROM stats s LEFT JOIN sizes z ON z.feature = s.feature
""",
    "validate_examples": """
WITH n AS (SELECT count(*) AS all_rows, count(*) FILTER (event_type = 'view') AS views,
                  count(*) FILTER (event_type = 'error') AS errors FROM events)
SELECT 'user_id' AS feature, 'missing_values' AS anomaly, NULL AS detail, views AS rows FROM n
UNION ALL SELECT 'value', 'type_change', 'FLOAT>BYTES', all_rows FROM n
UNION ALL SELECT 'props', 'missing_feature', NULL, 0 FROM n
UNION ALL SELECT 'channel', 'new_feature', 'BYTES', all_rows FROM n
UNION ALL SELECT 'event_type', 'value_outside_domain', 'error', errors FROM n
""",
    "eval_metrics": f"""
WITH {_PREDICTIONS}
SELECT count(*) AS example_count,
       round(avg(((score >= 0.5) = (label >= 0.5))::INTEGER), 6) AS accuracy,
       round(avg(abs(score - label)), 6) AS mae,
       round(avg((score - label) * (score - label)), 6) AS mse
FROM predicted
""",
    "bless_model": f"""
WITH {_PREDICTIONS},
candidate AS (SELECT avg(((score >= 0.5) = (label >= 0.5))::INTEGER) AS a FROM predicted),
baseline AS (SELECT avg((toxic = 0)::INTEGER) AS b FROM labels)
SELECT 'toxicity' AS model_name, round(a, 6) AS accuracy, round(b, 6) AS baseline_accuracy,
       (a >= 0.5 AND a - b >= -1e-10)::INTEGER AS blessed
FROM candidate, baseline
""",
    "latest_blessed": """
SELECT o_orderpriority AS model_name, lpad(o_orderkey::VARCHAR, 12, '0') AS model_id,
       epoch(o_orderdate)::BIGINT AS created_at, round(o_totalprice / 1000000, 6) AS accuracy
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
      FROM orders WHERE o_orderstatus = 'F')
WHERE n = 1
""",
}
