"""SQL for the message queries, written from the tables, without going through JSON."""

_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def hits(text: str, words: str) -> str:
    tokens = f"regexp_extract_all({_LOWER.format(text=text)}, '[a-z]+')"
    return f"len(list_filter({tokens}, lambda w: w IN ({words})))"


def probabilities(text: str) -> str:
    """Three columns ``pa, pb, pc``."""
    groups = {
        "pa": "'scum', 'trash', 'clown'",
        "pb": "'idiot', 'moron', 'stupid', 'loser'",
        "pc": "'worthless', 'pathetic', 'disgusting'",
    }
    return ", ".join(
        f"least(0.05::DOUBLE + 0.30::DOUBLE * {hits(text, words)}, 0.95::DOUBLE) AS {name}"
        for name, words in groups.items()
    )


CONFLATED = "pa * pb * pc / (pa * pb * pc + (1 - pa) * (1 - pb) * (1 - pc))"

# Events whose sender's clock is wrong.
_WRONG_CLOCK = "(event_id % 3 = 2 AND (event_id % 97 = 2 OR event_id % 101 = 2 OR event_id % 103 = 2))"

SCORED_DOCUMENTS = f"""
scored AS (
  SELECT doc_id, pa, pb, pc, {CONFLATED} AS score
  FROM (SELECT doc_id, {probabilities('text')} FROM documents)
)"""

SCORE_TEXT = f"""
WITH {SCORED_DOCUMENTS}
SELECT doc_id, round(score, 6) AS score, round(pa, 6) AS identity_attack, round(pb, 6) AS insult,
       round(pc, 6) AS sexually_explicit
FROM scored
"""

SENTENCES = "list_filter(regexp_split_to_array(text, '\\. |\\? |! '), lambda s: len(s) >= 3)"

EVENT_SCORES = """
scores AS (
  SELECT user_id::VARCHAR AS userid, ts AS event_time, least(value / 100, 1.0::DOUBLE) AS score FROM events
)"""

CHAT_SCORES = """
scores AS (
  SELECT e.user_id::VARCHAR AS userid, e.ts AS event_time, s.score
  FROM scored s JOIN events e ON e.event_id = s.doc_id
)"""


def user_windows(slide: str, count: int) -> str:
    return f"""
windows AS (
  SELECT userid,
         time_bucket(INTERVAL {slide}, event_time) - k * INTERVAL {slide} AS window_start,
         time_bucket(INTERVAL {slide}, event_time) - k * INTERVAL {slide} + {count} * INTERVAL {slide} AS window_end,
         coalesce(sum(score), 0) / count(*) AS score
  FROM scores, range({count}) r(k)
  GROUP BY ALL
)"""


WINDOW_COLUMNS = """
userid, epoch(window_start)::BIGINT AS window_start, epoch(window_end)::BIGINT AS window_end,
round(score, 6) AS score"""

RISING = """
edges AS (
  SELECT *, score >= 0.6 - 1e-12 AS toxic,
         lag(score >= 0.6 - 1e-12) OVER (PARTITION BY userid ORDER BY window_start) AS was_toxic
  FROM windows
),
flags AS (SELECT * FROM edges WHERE toxic AND NOT coalesce(was_toxic, false))"""

_HALF_HOUR = user_windows("5 minute", 6)

# Messages lose no piece, however short.
PIECES = "list_filter(regexp_split_to_array(text, '\\. |\\? |! '), lambda s: len(s) > 0)"

CONVERSATION_SENTENCES = f"""
sentences AS (
  SELECT conv_id, turn, role, unnest({PIECES}) AS sentence FROM conversations
),
scored AS (
  SELECT conv_id, turn, role, sentence, {CONFLATED} AS score
  FROM (SELECT conv_id, turn, role, sentence, {probabilities('sentence')} FROM sentences)
)"""

SCORED_ROWS = f"""
WITH {CONVERSATION_SENTENCES}
SELECT role || '-' || conv_id AS userid, turn * 60 AS "timestamp", sentence AS text, round(score, 6) AS score
FROM scored
"""

WINDOW_USER_AVG = f"WITH {EVENT_SCORES}, {_HALF_HOUR} SELECT {WINDOW_COLUMNS} FROM windows"

SQL = {
    "toxic_flags": f"""
WITH {SCORED_DOCUMENTS}, {CHAT_SCORES}, {user_windows('1 hour', 6)}, {RISING}
SELECT {WINDOW_COLUMNS} FROM flags
""",
    "event_flags": f"""
WITH {EVENT_SCORES}, {_HALF_HOUR}, {RISING}
SELECT {WINDOW_COLUMNS} FROM flags
""",
    "toxic_flags_stream": f"""
WITH {EVENT_SCORES}, {_HALF_HOUR}, {RISING}
SELECT userid, epoch(window_end)::BIGINT AS window_end, round(score, 6) AS score
FROM flags
""",
    "alerts_of_sources": f"""
WITH scores AS (
  SELECT user_id::VARCHAR AS userid, ts AS event_time, least(value / 100, 1.0::DOUBLE) AS score FROM events
  WHERE NOT {_WRONG_CLOCK}), {_HALF_HOUR}, {RISING}
SELECT userid, epoch(window_end)::BIGINT AS window_end, round(score, 6) AS score
FROM flags
""",
    "rows_of_sources": f"""
SELECT 's' || event_id % 3 AS source, CASE WHEN {_WRONG_CLOCK} THEN 'set aside' ELSE 'taken' END AS became, count(*) AS messages
FROM events GROUP BY ALL
""",
    "window_user_avg": WINDOW_USER_AVG,
    "window_user_avg_panes": WINDOW_USER_AVG,
    "score_text": SCORE_TEXT,
    "score_text_pandas": SCORE_TEXT,
    "sentence_split": f"""
SELECT conv_id, turn, (unnest(range(len(found))))::BIGINT AS position, unnest(found) AS sentence
FROM (SELECT conv_id, turn, {SENTENCES} AS found FROM conversations)
""",
    "scored_rows": SCORED_ROWS,
    "scored_rows_stream": SCORED_ROWS,
    "scored_envelope": f"""
WITH {CONVERSATION_SENTENCES},
per_turn AS (SELECT conv_id, turn, count(*) AS n, round(max(score), 6) AS m FROM scored GROUP BY ALL)
SELECT c.conv_id, c.turn, coalesce(n, 0) AS sentences, m AS max_score, coalesce(n, 0) AS entries
FROM conversations c LEFT JOIN per_turn USING (conv_id, turn)
""",
    "parse_events": """
SELECT event_id,
       CASE WHEN event_type IN ('error', 'view') THEN 'quarantined' ELSE 'parsed' END AS status,
       CASE WHEN event_type NOT IN ('error', 'view') THEN regexp_extract(props, '[0-9]+')::BIGINT END AS k
FROM events
""",
    "default_timestamp": """
WITH stamped AS (
  SELECT event_id,
         CASE event_type WHEN 'error' THEN 1700000000 WHEN 'view' THEN NULL
              ELSE floor(epoch(ts))::BIGINT END::BIGINT AS t
  FROM events
)
SELECT event_id, t AS "timestamp", t AS event_time FROM stamped
""",
    "normalize_text": f"""
WITH cut AS (
  SELECT conv_id, turn, CASE WHEN role = 'user' THEN [text] ELSE {PIECES} END AS found FROM conversations
)
SELECT conv_id, turn, len(found)::BIGINT AS segments,
       coalesce(list_sum(list_transform(found, lambda s: len(s))), 0)::BIGINT AS characters
FROM cut
""",
    "passthrough_keys": """
SELECT event_id,
       CASE WHEN event_type = 'click' THEN 2 ELSE 1 END::BIGINT AS kept,
       CASE WHEN event_type = 'click' THEN 'callback_url,userid' ELSE 'userid' END AS keys
FROM events
""",
    "attribute_extract": """
SELECT event_id,
       round(CASE WHEN event_type = 'signup' THEN 0 ELSE 1 - value / 1000 END, 6)::DOUBLE AS identity_attack,
       round(CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN NULL ELSE value / 1000 END, 6)::DOUBLE AS insult,
       (CASE WHEN event_type = 'signup' THEN 0 ELSE 0.25 END)::DOUBLE AS sexually_explicit
FROM events
""",
    "fallback_score": """
SELECT event_id,
       round(CASE WHEN event_type IN ('view', 'error') THEN 0.00001
                  WHEN event_type = 'signup' THEN 0
                  ELSE p * p * 0.25 / (p * p * 0.25 + (1 - p) * (1 - p) * 0.75) END, 6)::DOUBLE AS score
FROM (SELECT event_id, event_type, value / 1000 AS p FROM events)
""",
    "sequential_score": f"""
WITH scored AS (
  SELECT conv_id, role, turn, {CONFLATED} AS score
  FROM (SELECT conv_id, role, turn, {probabilities('text')} FROM conversations)
),
placed AS (
  SELECT *, row_number() OVER w AS n, coalesce(lag(score) OVER w, 0) AS before
  FROM scored WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)
)
SELECT conv_id, role, turn, CASE WHEN n <= 5 THEN n END AS position,
       round(CASE n WHEN 1 THEN before + score - 0.90::DOUBLE WHEN 2 THEN before + score - 0.93::DOUBLE
                    WHEN 3 THEN before + score - 0.95::DOUBLE WHEN 4 THEN before + score - 0.97::DOUBLE
                    WHEN 5 THEN before + score - 0.99::DOUBLE END, 6) AS sequential_score
FROM placed
""",
    "callback_decode": f"""
WITH {CONVERSATION_SENTENCES}
SELECT 'https://callback.example/' || role AS callback_url, role || '-' || conv_id AS userid, sentence AS text
FROM scored WHERE role <> 'system'
""",
    "analysis_requests": """
SELECT doc_id, text, 'IDENTITY_ATTACK,INSULT,SEXUALLY_EXPLICIT' AS attributes FROM documents
""",
}
