"""SQL for the audio queries."""

NOW = "1700000000"

_REQUESTS = """
requests AS (
  SELECT page_id,
         string_split(url, '?')[1] || ['.MP3', '.wav', '.flac', '.txt'][length(url) % 4 + 1] AS audio_uri
  FROM pages
)"""

_NAMED = f"""
found AS (
  SELECT page_id, regexp_extract(lower(audio_uri), '[a-zA-Z0-9\\-_ ()]+\\.(wav|mp3|flac)') AS raw FROM requests
),
named AS (
  SELECT page_id,
         CASE WHEN raw = '' THEN 'noid_{NOW}.mp3'
              ELSE regexp_replace(regexp_replace(raw, '[^a-zA-Z0-9.]', '_', 'g'), '^[^a-zA-Z]+', '') END AS file_name
  FROM found
)"""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = {
    "stt_long_segments": """
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS found FROM documents),
numbered AS (SELECT doc_id, unnest(range(len(found))) AS i, unnest(found) AS text FROM lines)
SELECT doc_id, i::BIGINT AS position, text,
       CASE WHEN i = 0 THEN '0s' ELSE (i * 7) || 's' END AS start_time, ((i + 1) * 7) || 's' AS end_time
FROM numbered
""",
    "stt_long_regroup": """
SELECT conv_id, turn,
       lag(((turn + 1) * 7) || 's', 1, '0s') OVER (PARTITION BY conv_id ORDER BY turn) AS start_time,
       ((turn + 1) * 7) || 's' AS end_time
FROM conversations
""",
    "stt_short_merge": """
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS found FROM documents)
SELECT doc_id,
       array_to_string(list_filter(found, lambda line, i: list_position(found, line) = i), ' ') AS text
FROM lines
""",
    "stt_attach_metadata": """
SELECT d.doc_id, d.n_chars, 'rec_' || d.doc_id || '.json' AS object_name, l.quality::BIGINT AS quality,
       CASE WHEN l.doc_id IS NULL THEN 'metadata missing' END AS error
FROM documents d LEFT JOIN labels l USING (doc_id)
""",
    "short_messages": f"""
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS found FROM documents)
SELECT 'rec_' || l.doc_id || '.json' AS object_name, 'rec_' || l.doc_id || '_{NOW}.json' AS result_name,
       array_to_string(list_filter(found, lambda line, i: list_position(found, line) = i), ' ') AS text,
       quality::VARCHAR AS userid, CASE WHEN quality IS NOT NULL THEN {NOW} END::BIGINT AS "timestamp",
       CASE WHEN quality IS NULL THEN 'metadata missing' END AS error
FROM lines l LEFT JOIN labels b ON b.doc_id = l.doc_id
""",
    "audio_manifest": f"""
WITH {_REQUESTS}, {_NAMED}
SELECT page_id, file_name,
       regexp_replace(lower(file_name), '\\.[a-z0-9]+$', '.flac') AS flac_name,
       regexp_replace(file_name, '\\.[a-z0-9]+$', '.json') AS sidecar_name,
       regexp_matches(file_name, '\\.flac$') AS is_flac
FROM named
""",
    "audio_name_collisions": f"""
WITH {_REQUESTS}, {_NAMED}
SELECT file_name, count(*) AS requests FROM named GROUP BY file_name HAVING count(*) > 1
""",
    "audio_route": """
SELECT doc_id,
       CASE WHEN lang = 'de' THEN 'rejected' WHEN n_chars / 10 < 60 THEN 'short' ELSE 'long' END AS route
FROM documents
""",
    "language_route": f"""
SELECT doc_id, (lang IN ('es', 'fr'))::INTEGER AS translated,
       CASE WHEN lang = 'es'
            THEN trim(replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              chr(10), ' '), {_SPACE})
            ELSE text END AS final_text
FROM documents
""",
    "object_names": """
WITH sent AS (
  SELECT event_id, event_type, floor(epoch(ts))::BIGINT AS clock, lower(c_name) AS who
  FROM events LEFT JOIN customer ON c_custkey = user_id
)
SELECT event_id,
       CASE WHEN who IS NULL THEN '' ELSE who || '_' END || clock || '.json' AS message_name,
       event_type || '.flac' AS flac_name,
       event_type || '.' || event_id || '.json' AS long_name,
       event_type || '.' || event_id || '_' || clock || '.json' AS short_name
FROM sent
""",
}
