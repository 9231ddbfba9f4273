"""SQL of the derived tables, for the queries' oracles. lectern.plans.adapters has the same in DataFrame terms."""

LABELS = """
labels_v AS (
  SELECT concat(CAST(doc_id AS VARCHAR), ':0') AS page_key, doc_id,
    CASE WHEN toxic = 1 THEN 'supported_failure' WHEN quality = 1 THEN 'clean' ELSE 'unsupported' END AS truth,
    CAST(doc_id % 5 AS INTEGER) AS expected_occurrences
  FROM labels)"""

READINGS = """
attempts AS (
  SELECT doc_id, text, n_chars, unnest(CASE WHEN doc_id % 3 = 0 THEN [1, 2] ELSE [1] END) AS attempt
  FROM documents WHERE doc_id % 10 <> 2),
readings AS (
  SELECT concat(CAST(doc_id AS VARCHAR), ':0') AS page_key, concat('check_', CAST(doc_id AS VARCHAR)) AS check_id, attempt,
    CASE WHEN doc_id % 10 = 0 AND attempt = 1 THEN 'timeout' WHEN doc_id % 10 = 1 THEN 'failed' ELSE 'completed' END AS status,
    regexp_matches(text, '[0-9]') AS digits,
    concat('f_', CAST(doc_id % 7 AS VARCHAR)) AS finding_id,
    CAST(n_chars % 5 AS INTEGER) AS occurrence_count,
    greatest((n_chars % 40) / 10.0::DOUBLE, (doc_id % 30) / 10.0::DOUBLE) AS error
  FROM attempts),
pages_v AS (
  SELECT page_key, count(*) AS readings, bool_or(status = 'completed' AND digits) AS resolved,
    count(DISTINCT CASE WHEN digits THEN finding_id END) AS n_findings,
    min(CASE WHEN status = 'completed' THEN occurrence_count END) AS min_count, max(error) AS max_error
  FROM readings GROUP BY page_key)"""

LINES = """
split_lines AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, unnest(generate_series(0, len(parts) - 1)) AS ordinal, unnest(parts) AS raw_text FROM split_lines),
lines_a AS (
  SELECT doc_id, ordinal, raw_text, 72.0::DOUBLE + (ordinal % 3) * 180.0::DOUBLE AS x0,
    60.0::DOUBLE + (ordinal // 3) * 14.0::DOUBLE AS y0,
    72.0::DOUBLE + (ordinal % 3) * 180.0::DOUBLE + 6.0::DOUBLE * least(length(raw_text), 25) AS x1,
    60.0::DOUBLE + (ordinal // 3) * 14.0::DOUBLE + 10.0::DOUBLE + (ordinal % 3) AS y1
  FROM numbered),
lines_b AS (
  SELECT doc_id, ordinal, replace(raw_text, '1', '7') AS raw_text, x0 + 1 AS x0, y0, x1 + 1 AS x1, y1
  FROM lines_a WHERE ordinal % 7 <> 6)"""

OBJECTS = """
objects AS (
  SELECT l_orderkey AS page, l_linenumber AS idx, CASE WHEN l_linenumber % 4 = 1 THEN 'text' ELSE 'path' END AS kind,
    (l_partkey % 50) * 4.0::DOUBLE AS x0, (l_suppkey % 25) * 8.0::DOUBLE AS y0,
    (l_partkey % 50) * 4.0::DOUBLE + 20.0::DOUBLE + l_quantity AS x1, (l_suppkey % 25) * 8.0::DOUBLE + 10.0::DOUBLE + l_quantity / 2 AS y1
  FROM lineitem)"""

CHECKS = """
checks AS (
  SELECT l_orderkey AS run, concat_ws('_', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS check_id,
    CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'O' THEN 'timeout' ELSE 'completed' END AS status
  FROM lineitem)"""

MESSAGES = """
messages AS (
  SELECT event_id AS arrival, concat('job_', CAST(user_id AS VARCHAR)) AS job_id,
    event_id - CASE WHEN event_id % 11 = 3 THEN 500 ELSE 0 END AS seq,
    CASE WHEN event_id % 13 = 0 THEN 1 ELSE 2 END AS generation, CASE WHEN event_id % 17 = 0 THEN 'old' ELSE 'run' END AS run_key,
    event_type = 'error' AS terminal, event_type, value
  FROM events)"""

#: White space as a class that RE2 and Java read alike.
SPACE = r"[\x09-\x0D \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def with_(*views: str, select: str) -> str:
    return "WITH " + ",".join(v.strip() for v in views) + "\n" + select.strip()


def wilson(k: str, n: str) -> tuple[str, str]:
    """Both bounds for z = 1.96, as SQL."""
    p, z2 = f"({k}::DOUBLE / {n})", "3.8416::DOUBLE"
    d = f"(1 + {z2} / {n})"
    middle, half = f"(({p} + {z2} / (2 * {n})) / {d})", f"(1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n}::DOUBLE * {n})) / {d})"
    return f"greatest(0, {middle} - {half})", f"least(1, {middle} + {half})"
