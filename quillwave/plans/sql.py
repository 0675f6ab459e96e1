"""Common table expressions of the SQL twins (DuckDB)."""

from __future__ import annotations

from ..sources.fixtures import SCRIPTS_SQL

NORMALIZED = SCRIPTS_SQL + r""", normalized AS (SELECT script_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '\[(\d+(?:\.\d+)?)\s*(?:second|sec|s)\s*pause\]', '[pause:\1s]', 'gi'), '\[breath\]', '[breath:breath]', 'gi'), '\[inhale\]', '[breath:inhale]', 'gi'), '\[exhale\]', '[breath:exhale]', 'gi') AS text FROM scripts)"""


def tokens(source: str, voices: bool) -> str:
    """CTE segs: the segment rows of `source`(script_id, text)."""
    voice = r"|\[voice:[^\]]+\]" if voices else ""
    return rf"""raw AS (SELECT script_id, unnest(range(0, len(parts))) AS part, unnest(parts) AS raw FROM (SELECT script_id, string_split(regexp_replace(text,
 '(\[pause:\d+(?:\.\d+)?s\]|\[para-pause:\d+(?:\.\d+)?s\]|\[breath:(?:breath|inhale|exhale)\]{voice})', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS parts FROM {source})),
typed AS (SELECT script_id, part, CASE WHEN part % 2 = 0 THEN 'speech' WHEN raw LIKE '[breath:%' THEN 'breath' WHEN raw LIKE '[voice:%' THEN 'voice' ELSE 'pause' END AS type, raw FROM raw),
fields AS (SELECT script_id, part, type, CASE WHEN type = 'speech' THEN regexp_replace(raw, '^\s+|\s+$', '', 'g') END AS text,
 CASE WHEN type = 'pause' THEN CAST(regexp_extract(raw, 'pause:([0-9.]+)s', 1) AS DOUBLE) END AS duration_sec,
 CASE WHEN type = 'pause' THEN CASE WHEN raw LIKE '[para-%' THEN 'paragraph' ELSE 'explicit' END END AS source,
 CASE WHEN type = 'breath' THEN regexp_extract(raw, '^\[breath:(.*)\]$', 1) END AS subtype,
 CASE WHEN type = 'voice' THEN trim(regexp_extract(raw, '^\[voice:(.*)\]$', 1)) END AS voice FROM typed),
segs AS (SELECT script_id, CAST(row_number() OVER (PARTITION BY script_id ORDER BY part) - 1 AS INT) AS seg_no, type, text, duration_sec, source, subtype, voice
 FROM fields WHERE coalesce(len(text), 1) > 0 AND coalesce(duration_sec, 1) > 0)"""


def merged(source: str, name: str, length: str) -> str:
    """CTE `name`: runs of pauses of `source` in one row."""
    return f"""{name}_run AS (SELECT *, sum(CASE WHEN type <> 'pause' THEN 1 ELSE 0 END) OVER (PARTITION BY script_id ORDER BY seg_no) AS run FROM {source}),
{name}_all AS (SELECT script_id, min(seg_no) AS place, 'pause' AS type, NULL AS text, {length} AS duration_sec, min(source) AS source, NULL AS subtype, NULL AS voice FROM {name}_run WHERE type = 'pause' GROUP BY script_id, run
 UNION ALL SELECT script_id, seg_no, type, text, duration_sec, source, subtype, voice FROM {name}_run WHERE type <> 'pause'),
{name} AS (SELECT script_id, CAST(row_number() OVER (PARTITION BY script_id ORDER BY place) - 1 AS INT) AS seg_no, type, text, duration_sec, source, subtype, voice FROM {name}_all)"""


SUPPRESSED = r"""blocks AS (SELECT script_id, regexp_split_to_array(text, '\n\n+') AS b FROM normalized),
lone AS (SELECT script_id, b, list_transform(b, lambda x : regexp_matches(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^\[pause:\d+(?:\.\d+)?s\]$')) AS l FROM blocks),
suppressed AS (SELECT script_id, array_to_string(list_transform(range(1, len(b) + 1), lambda i : b[i] || CASE WHEN i = len(b) THEN '' WHEN l[i] OR l[i + 1] THEN ' ' ELSE ' [pause:3.0s] ' END), '') AS text FROM lone)"""

FILLED = """filled_all AS (SELECT *, last_value(voice IGNORE NULLS) OVER (PARTITION BY script_id ORDER BY seg_no) AS v FROM longest),
filled AS (SELECT script_id, CAST(row_number() OVER (PARTITION BY script_id ORDER BY seg_no) - 1 AS INT) AS seg_no, type, text, duration_sec, source, subtype, CASE WHEN type = 'speech' THEN v END AS voice FROM filled_all WHERE type <> 'voice')"""

#: The second policy in full: CTE filled.
PARSED = ",\n".join([NORMALIZED, SUPPRESSED, tokens("suppressed", True), merged("segs", "longest", "max(duration_sec)"), FILLED])

WORDS = r"CASE WHEN regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+')) END"


def words(column: str) -> str:
    return WORDS.format(column)
