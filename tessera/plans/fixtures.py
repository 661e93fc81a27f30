"""Shapes of the review tables, made from the benchmark tables: changes, findings, histories, spans. The SQL twins stand beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.session import table

CHANGES_SQL = """changes AS (SELECT doc_id, 'src/' || source || '/' ||
  CASE doc_id % 6 WHEN 0 THEN 'doc.py' WHEN 1 THEN 'doc.md' WHEN 2 THEN 'test_doc.py' WHEN 3 THEN 'notes.txt' WHEN 4 THEN 'package.json' ELSE 'main.c' END AS path,
  CASE WHEN doc_id % 3 = 0 THEN '@@ -1,3 +5,3 @@' || chr(10) || '+' || replace(text, chr(10), chr(10) || ' ')
       WHEN doc_id % 3 = 1 THEN '@@ -1 +9 @@' || chr(10) || '-' || replace(text, chr(10), chr(10) || '-') || chr(10) || '@@ -40 +30 @@' || chr(10) || '+' || replace(text, chr(10), ' ' || chr(10) || '+')
       ELSE '@@ -7 +7 @@' || chr(10) || ' ' || replace(text, chr(10), chr(10) || '+# ') END AS diff FROM documents)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One changed file per document: (doc_id, path, diff)."""
    doc, nl = F.col("doc_id"), "\n"
    name = F.when(doc % 6 == 0, "doc.py").when(doc % 6 == 1, "doc.md").when(doc % 6 == 2, "test_doc.py").when(doc % 6 == 3, "notes.txt").when(doc % 6 == 4, "package.json").otherwise("main.c")
    sub = lambda to: F.replace(F.col("text"), F.lit(nl), F.lit(to))
    diff = (
        F.when(doc % 3 == 0, F.concat(F.lit("@@ -1,3 +5,3 @@\n+"), sub("\n ")))
        .when(doc % 3 == 1, F.concat(F.lit("@@ -1 +9 @@\n-"), sub("\n-"), F.lit("\n@@ -40 +30 @@\n+"), sub(" \n+")))
        .otherwise(F.concat(F.lit("@@ -7 +7 @@\n "), sub("\n+# ")))
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src/"), "source", F.lit("/"), name).alias("path"), diff.alias("diff"))


SEVERITY_SQL = "CASE WHEN value >= 80 THEN 'critical' WHEN value >= 60 THEN 'high' WHEN value >= 40 THEN 'medium' WHEN value >= 20 THEN 'low' ELSE 'info' END"
FINDINGS_SQL = f"""findings AS (SELECT event_id, 'app/m' || (user_id % 7) || '/f' || user_id || '.py' AS file_path, (event_id % 40)::INT AS line_number,
  CASE event_type WHEN 'error' THEN 'SAST.SQL_INJECTION' WHEN 'purchase' THEN 'SAST.XSS' WHEN 'signup' THEN 'QUALITY.SRP' WHEN 'click' THEN 'PERFORMANCE.N_PLUS_ONE' ELSE 'DOCS.DEAD_REFERENCE' END AS rule_id,
  {SEVERITY_SQL} AS severity, CAST(ts AS DATE) AS day FROM events)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per event: (event_id, file_path, line_number, rule_id, severity, day)."""
    v, kind, user = F.col("value"), F.col("event_type"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("app/m"), (user % 7).cast("string"), F.lit("/f"), user.cast("string"), F.lit(".py")).alias("file_path"),
        (F.col("event_id") % 40).cast("int").alias("line_number"),
        F.when(kind == "error", "SAST.SQL_INJECTION").when(kind == "purchase", "SAST.XSS").when(kind == "signup", "QUALITY.SRP").when(kind == "click", "PERFORMANCE.N_PLUS_ONE").otherwise("DOCS.DEAD_REFERENCE").alias("rule_id"),
        F.when(v >= 80, "critical").when(v >= 60, "high").when(v >= 40, "medium").when(v >= 20, "low").otherwise("info").alias("severity"),
        F.to_date("ts").alias("day"),
    )


HISTORY_SQL = FINDINGS_SQL + """, history AS (SELECT 'finding' AS kind, file_path, rule_id, min(day) AS first_seen, max(day) AS last_seen,
  list_extract(['critical','high','medium','low','info'], min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END) + 1) AS severity,
  count(*) AS occurrences FROM findings GROUP BY file_path, rule_id),
today AS (SELECT max(day) AS today FROM findings),
salient AS (SELECT h.*, occurrences * CASE severity WHEN 'critical' THEN 5.0 WHEN 'high' THEN 4.0 WHEN 'medium' THEN 3.0 WHEN 'low' THEN 2.0 ELSE 1.0 END
  * pow(0.5::DOUBLE, greatest(0, date_diff('day', last_seen, today)) / 30.0::DOUBLE) AS salience FROM history h, today)"""


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select(F.lit("finding").alias("kind"), "file_path", "rule_id", F.col("day").alias("first_seen"), F.col("day").alias("last_seen"), "severity", F.lit(1).cast("long").alias("occurrences"), F.lit("").alias("reason"))


SPANS_SQL = """spans AS (SELECT user_id AS trace_id, event_id::VARCHAR AS span_id,
  CASE WHEN event_id % 19 = 0 THEN 'lost' || event_id ELSE coalesce((lag(event_id, 2) OVER w)::VARCHAR, (lag(event_id, 1) OVER w)::VARCHAR, '') END AS parent_id,
  event_type AS kind, epoch_ms(ts) AS started_ms, CASE WHEN event_id % 11 = 0 THEN NULL ELSE epoch_ms(ts) + CAST(floor(value * 1000) AS BIGINT) END AS ended_ms
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
known AS (SELECT s.*, CASE WHEN parent_id = '' OR p.span_id IS NULL THEN NULL ELSE parent_id END AS p, parent_id <> '' AND p.span_id IS NULL AS orphan
  FROM spans s LEFT JOIN (SELECT trace_id AS t, span_id FROM spans) p ON p.t = s.trace_id AND p.span_id = s.parent_id),
roots AS (SELECT trace_id, arg_min(span_id, (started_ms, span_id)) AS root FROM known WHERE p IS NULL GROUP BY trace_id),
tree AS (SELECT k.trace_id, span_id, kind, started_ms, ended_ms, CASE WHEN p IS NULL AND span_id <> root THEN root ELSE p END AS parent,
  CASE WHEN orphan THEN 'orphan' WHEN p IS NULL AND span_id <> root THEN 'second_root' END AS anomaly FROM known k JOIN roots r ON r.trace_id = k.trace_id)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace per user: an event's parent is the one two before, else the one before; some are lost, some are open."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events")
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    parent = F.when(F.col("event_id") % 19 == 0, F.concat(F.lit("lost"), F.col("event_id").cast("string"))).otherwise(F.coalesce(F.lag("event_id", 2).over(w).cast("string"), F.lag("event_id", 1).over(w).cast("string"), F.lit("")))
    return e.select(F.col("user_id").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), parent.alias("parent_id"), F.col("event_type").alias("kind"), start.alias("started_ms"), F.when(F.col("event_id") % 11 != 0, start + F.floor(F.col("value") * 1000)).alias("ended_ms"))
