"""The registered queries of the review engine, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.functions import severity, stats
from tessera.functions.text import BLANK, ENDS, basename, directory, estimated_tokens, is_binary, tokens
from tessera.operators import chain, chunking, evaluation, history, joins, retrieval, rollup, routing, scan, trace
from tessera.plans import policy
from tessera.plans.fixtures import CHANGES_SQL, FINDINGS_SQL, HISTORY_SQL, SPANS_SQL, changes, findings, sightings, spans
from tessera.session import materialised, prepare, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Text ------------------------------------------------------------------------------------------------------------------

MARK_SQL = r"regexp_replace(regexp_replace(translate(w, '_', ' '), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')"
TOKENS_SQL = rf"flatten(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda w: list_concat([lower(w)], list_filter(list_transform(string_split({MARK_SQL}, ' '), lambda p: lower(p)), lambda p: p <> '' AND p <> lower(w)))))"


@registered(f"SELECT doc_id, len({TOKENS_SQL})::INT AS n_tokens, md5(array_to_string({TOKENS_SQL}, ' ')) AS digest, length(text) // 4 AS estimate, contains(text, chr(0)) OR (length(text) - length(replace(text, '�', ''))) > greatest(1.0, length(text) / 100.0) AS is_binary FROM documents")
def tokenise(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents"))
    return d.select("doc_id", tokens(F.col("text")).alias("t"), "text").select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"), estimated_tokens(F.col("text")).alias("estimate"), is_binary(F.col("text")).alias("is_binary"))


BM25_SQL = f"""docs AS (SELECT doc_id, {TOKENS_SQL} AS terms FROM documents),
size AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM docs),
asked AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS_SQL}) AS term FROM benchmark) GROUP BY ALL),
hits AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS len, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scores AS (SELECT item_id AS query, doc_id AS key, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score
  FROM hits JOIN freq USING (term) JOIN asked USING (term), size GROUP BY ALL),
bm AS (SELECT query, key, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INT AS place FROM scores WHERE score > 0)"""


@registered(f"WITH {BM25_SQL} SELECT query, key, score, place FROM bm WHERE place <= 10")
def bm25_topk(spark, sf_dir):
    return retrieval.bm25(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")).select("query", "key", "score", "place")


@registered(f"""WITH {BM25_SQL}, shared AS (SELECT item_id AS query, doc_id AS key, count(*) AS n FROM hits JOIN asked USING (term) GROUP BY ALL),
overlap AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY n DESC, key) AS place FROM shared),
lists AS (SELECT query, key, place FROM bm WHERE place <= 20 UNION ALL SELECT query, key, place FROM overlap WHERE place <= 20)
SELECT query, key, round(sum(1.0 / (60 + place)), 6) AS score FROM lists GROUP BY ALL""")
def hybrid_rrf(spark, sf_dir):
    docs, asked = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")
    hits = retrieval.asked_terms(docs, asked.select(F.explode(tokens(F.col("text"))).alias("term")).distinct())
    first = retrieval.bm25(docs, asked, limit=20, hits=hits).select("query", F.lit("bm25").alias("source"), "key", "place")
    second = retrieval.overlap(docs, asked, 20, hits=hits).select("query", F.lit("overlap").alias("source"), "key", "place")
    return retrieval.fuse(first.unionByName(second)).select("query", "key", F.round("score", 6).alias("score"))


@registered("""WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query, vec_id AS key, round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings ON vec_id <> query)
SELECT query, key, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS place FROM s) WHERE place <= 10""")
def cosine_knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return retrieval.knn(e, e.filter("vec_id % 50 = 0")).select("query", "key", "score")


@registered(f"""WITH spots AS (SELECT item_id, list_transform({TOKENS_SQL}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 64) AS s FROM benchmark),
counts AS (SELECT item_id, list_transform(range(64), lambda i: len(list_filter(s, lambda x: x = i))::DOUBLE) AS c FROM spots),
norms AS (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS norm FROM counts)
SELECT item_id, (unnest(range(64)))::INT AS dimension, round(unnest(list_transform(c, lambda x: CASE WHEN norm = 0 THEN 0 ELSE x / norm END)), 6) AS value FROM norms""")
def hashing_embed(spark, sf_dir):
    made = retrieval.hashed(table(spark, sf_dir, "benchmark"), "item_id", "text", "vector", 64)
    return made.select("item_id", F.posexplode("vector").alias("dimension", "value")).withColumn("value", F.round("value", 6))


def _mmr_sql(candidates: str, limit: int, weight: float = retrieval.LAMBDA) -> str:
    """Recursive picks over ``candidates`` (query, key, score, v): CTEs listed, walk and picked (query, key, place)."""
    gain = f"CASE WHEN len(chosen) = 0 THEN x.score ELSE {weight} * x.score / greatest(c[1].score, 1e-12) - (1 - {weight}) * list_max(list_transform(chosen, lambda j: CASE WHEN x.zero OR c[j].zero THEN 0.0 ELSE greatest(-1, least(1, list_cosine_similarity(x.v, c[j].v))) END)) END"
    return f"""listed AS (SELECT query, list({{'key': key, 'score': score, 'v': v, 'zero': list_max(list_transform(v, lambda x: abs(x))) = 0}} ORDER BY score DESC, key) AS c FROM {candidates} GROUP BY query),
walk AS (SELECT query, c, []::INT[] AS chosen FROM listed UNION ALL
  SELECT query, c, list_append(chosen, list_sort(list_filter(list_transform(c, lambda x, i: {{'loss': -round({gain}, 12), 'at': i::INT, 'open': NOT list_contains(chosen, i)}}), lambda o: o.open))[1].at) FROM walk WHERE len(chosen) < least({limit}, len(c))),
picked AS (SELECT query, c[chosen[len(chosen)]].key AS key, len(chosen)::BIGINT AS place FROM walk WHERE len(chosen) > 0)"""


def _hashed_sql(name: str, source: str, key: str, width: int) -> str:
    """``name`` (key, v): counts of the buckets of a text's tokens."""
    return f"""{name} AS (SELECT {key} AS key, list_transform(range({width}), lambda i: len(list_filter(s, lambda x: x = i))::DOUBLE) AS v FROM (SELECT {key}, list_transform({TOKENS_SQL}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {width}) AS s FROM {source}))"""


@registered(f"""WITH RECURSIVE {BM25_SQL}, {_hashed_sql('dv', 'documents', 'doc_id', 128)}, {_hashed_sql('qv', 'benchmark', 'item_id', 128)},
sims AS (SELECT q.key AS query, d.key, round(CASE WHEN list_max(q.v) = 0 OR list_max(d.v) = 0 THEN 0 ELSE greatest(-1, least(1, list_cosine_similarity(q.v, d.v))) END, 6) AS score FROM qv q, dv d),
nearest AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS place FROM sims),
fused AS (SELECT query, key, round(sum(1.0 / (60 + place)), 9)::DOUBLE AS score FROM (SELECT query, key, place FROM bm WHERE place <= 20 UNION ALL SELECT query, key, place FROM nearest WHERE place <= 20) GROUP BY ALL),
cand AS (SELECT query, key, score, v FROM fused JOIN dv USING (key)), {_mmr_sql('cand', 5)}
SELECT query, key, place FROM picked""")
def hybrid_related(spark, sf_dir):
    docs, asked = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")
    vectors = retrieval.hashed(docs, "doc_id", "text", "vector", 128).withColumnRenamed("doc_id", "key")
    wanted = retrieval.hashed(asked, "item_id", "text", "vector", 128).withColumnRenamed("item_id", "key")
    near = materialised(retrieval.knn(vectors, wanted, 20, key="key", vector="vector", exclude_self=False))
    lexical = materialised(retrieval.bm25(docs, asked, limit=20))
    listed = near.select("key").union(lexical.select("key")).distinct()  # only these documents' vectors are made again
    chosen = retrieval.hashed(docs.join(F.broadcast(listed), docs["doc_id"] == listed["key"], "left_semi"), "doc_id", "text", "vector", 128)
    return retrieval.related(lexical, near, chosen.withColumnRenamed("doc_id", "key")).select("query", "key", "place")


# Chunks ----------------------------------------------------------------------------------------------------------------


@registered(r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS lines FROM documents WHERE regexp_matches(text, '\S')),
s AS (SELECT doc_id, lines, unnest(range(0, greatest(0, ceil((len(lines) - 4) / 3.0))::INT * 3 + 1, 3)) AS from0 FROM l),
w AS (SELECT doc_id, (from0 + 1)::INT AS start_line, from0, lines[from0 + 1 : from0 + 4] AS block FROM s)
SELECT doc_id, start_line, (from0 + len(block))::INT AS end_line, md5(array_to_string(block, chr(10))) AS digest FROM w WHERE regexp_matches(array_to_string(block, chr(10)), '\S')""")
def chunk_windows(spark, sf_dir):
    cut = chunking.windows(spread(table(spark, sf_dir, "documents")), "doc_id", "text", window=4, overlap=1)
    return cut.select(F.col("path").alias("doc_id"), "start_line", "end_line", F.md5(F.col("text").cast("binary")).alias("digest"))


@registered(r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '\n$', ''), chr(10))) AS body, generate_subscripts(string_split(regexp_replace(t, '\n$', ''), chr(10)), 1) AS line FROM (SELECT doc_id, '# T' || doc_id || chr(10) || replace(text, '. ', '.' || chr(10) || '## S' || chr(10)) AS t FROM documents)),
f AS (SELECT *, sum(CASE WHEN regexp_matches(body, '^\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) % 2 = 1 AS fenced FROM l),
h AS (SELECT *, NOT fenced AND regexp_matches(body, '^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$') AS is_heading FROM f),
s AS (SELECT *, sum(is_heading::INT) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM h),
b AS (SELECT *, (line - min(line) OVER (PARTITION BY doc_id, section)) // 3 AS block, max(CASE WHEN is_heading THEN regexp_extract(body, '^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$', 1) END) OVER (PARTITION BY doc_id, section) AS title FROM s)
SELECT doc_id, min(line)::INT AS start_line, max(line)::INT AS end_line, md5(string_agg(body, chr(10) ORDER BY line)) AS digest, coalesce(max(title), '') AS name FROM b GROUP BY doc_id, section, block HAVING regexp_matches(string_agg(body, chr(10) ORDER BY line), '\S')""")
def chunk_markdown(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.concat(F.lit("# T"), F.col("doc_id").cast("string"), F.lit("\n"), F.replace(F.col("text"), F.lit(". "), F.lit(".\n## S\n"))).alias("t"))
    return chunking.markdown(d, "doc_id", "t", 3).select(F.col("path").alias("doc_id"), "start_line", "end_line", F.md5(F.col("text").cast("binary")).alias("digest"), "name")


@registered(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
c AS (SELECT doc_id, line, trim(regexp_replace(body, '""" + BLANK + r"""+', ' ', 'g')) AS tidy FROM l),
k AS (SELECT * FROM c WHERE tidy <> '' AND NOT starts_with(tidy, '#') AND NOT starts_with(tidy, '//')),
b AS (SELECT doc_id, line, list(tidy) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS block FROM k)
SELECT doc_id, md5(array_to_string(block, chr(10))) AS hash, array_to_string(list_sort(list(line)), ',') AS starts FROM b WHERE len(block) = 2 GROUP BY doc_id, md5(array_to_string(block, chr(10))) HAVING count(*) > 1""")
def duplicate_blocks(spark, sf_dir):
    found = chunking.duplicate_blocks(spread(table(spark, sf_dir, "documents")), "doc_id", "text", 2)
    return found.select(F.col("path").alias("doc_id"), "hash", F.array_join("starts", ",").alias("starts"))


@registered("""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
w AS (SELECT doc_id, n, 0 AS part, length(body) + 1 AS size FROM l WHERE n = 1 UNION ALL
  SELECT l.doc_id, l.n, w.part + CASE WHEN w.size + length(l.body) + 1 > 300 THEN 1 ELSE 0 END, CASE WHEN w.size + length(l.body) + 1 > 300 THEN 0 ELSE w.size END + length(l.body) + 1 FROM w JOIN l ON l.doc_id = w.doc_id AND l.n = w.n + 1)
SELECT doc_id, part::INT AS part, (max(size) - 1)::INT AS chars FROM w GROUP BY doc_id, part""")
def greedy_chunks(spark, sf_dir):
    return chunking.greedy(spread(table(spark, sf_dir, "documents")), "doc_id", "text", 300).select(F.col("path").alias("doc_id"), "part", F.length("text").alias("chars"))


# Scans -----------------------------------------------------------------------------------------------------------------


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _rule_sql() -> str:
    """RE2 has no lookahead: the one rule that needs it is a match without the excluded continuation."""
    lookahead = r"(?![^)]*Loader\s*=)"
    cases = []
    for i, (lang, kind, pattern, sev, _cwe) in enumerate(scan.RULES):
        if lookahead in pattern:
            test = rf"regexp_matches(body, {_q('(?i)' + pattern.replace(lookahead, ''))}) AND NOT regexp_matches(body, {_q('(?i)' + pattern.replace(lookahead, '') + r'[^)]*Loader\s*=')})"
        else:
            test = f"regexp_matches(body, {_q('(?i)' + pattern)})"
        cases.append(f"SELECT doc_id, line, {i + 1} AS rule_no, 'SAST.{kind}' AS rule_id, '{sev}' AS severity, substr(bare, 1, 100) AS evidence FROM l WHERE lang = '{'cpp' if lang == 'cpp' else 'python'}' AND {test}")
    return (
        "WITH raw AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'cpp' ELSE 'python' END AS lang, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line FROM documents), "
        f"l AS (SELECT * FROM (SELECT *, regexp_replace(body, '{ENDS}', '', 'g') AS bare FROM raw) WHERE NOT CASE WHEN lang = 'python' THEN starts_with(bare, '#') OR starts_with(bare, '\"\"\"') OR starts_with(bare, '''''''') ELSE starts_with(bare, '//') OR starts_with(bare, '/*') OR starts_with(bare, '*') END) "
        + " UNION ALL ".join(cases)
    )


@registered(_rule_sql())
def rule_scan(spark, sf_dir):
    lines = joins.lines_of(spread(table(spark, sf_dir, "documents")), "text", "doc_id")
    return scan.scan_lines(lines, F.when(F.col("doc_id") % 4 == 0, "cpp").otherwise("python")).select("doc_id", "line", "rule_no", "rule_id", "severity", "evidence")


def _redact_sql() -> str:
    ctes, before = ["r0 AS (SELECT doc_id, text AS t, 0 AS n FROM documents)"], "r0"
    for i, (pattern, group) in enumerate(scan.SECRETS):
        counted = "(?i)" + pattern
        whole, put = scan.masking(pattern, group)
        put = put.format("\\")
        ctes.append(f"r{i + 1} AS (SELECT doc_id, regexp_replace(t, {_q(whole)}, {_q(put)}, 'g') AS t, n + len(regexp_extract_all(t, {_q(counted)})) AS n FROM {before})")
        before = f"r{i + 1}"
    return f"WITH {', '.join(ctes)} SELECT doc_id, md5(t) AS digest, n::INT AS masked FROM {before}"


@registered(_redact_sql())
def redact_secrets(spark, sf_dir):
    return scan.redact(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), "text").select("doc_id", F.md5(F.col("redacted").cast("binary")).alias("digest"), "masked")


def _any_sql(column: str, patterns, flags: str = "") -> str:
    parts = []
    for p in patterns:
        if p.startswith("^(?!.*requirements)"):
            parts.append(f"(regexp_matches({column}, {_q(flags + p.replace('(?!.*requirements)', ''))}) AND NOT contains(lower({column}), 'requirements'))")
        else:
            parts.append(f"regexp_matches({column}, {_q(flags + p)})")
    return "(" + " OR ".join(parts) + ")"


TRIAGE_SQL = CHANGES_SQL + f""", lines AS (SELECT *, string_split(diff, chr(10)) AS x FROM changes),
sides AS (SELECT doc_id, path, diff, list_transform(list_filter(x, lambda i: starts_with(i, '+') AND NOT starts_with(i, '+++')), lambda i: substr(i, 2)) AS added,
  list_transform(list_filter(x, lambda i: starts_with(i, '-') AND NOT starts_with(i, '---')), lambda i: substr(i, 2)) AS removed FROM lines),
counted AS (SELECT *, len(added) + len(removed) AS n, list_concat(added, removed) AS both_sides FROM sides),
triaged AS (SELECT doc_id, n::INT AS n_changes, CASE WHEN {_any_sql('path', scan.SKIP, '(?i)')} THEN 'skip'
  WHEN {_any_sql("array_to_string(added, chr(10))", scan.BANNED, '(?i)')} OR {_any_sql('diff', scan.API_CHANGES, '(?m)')} THEN 'critical'
  WHEN {_any_sql('path', scan.MANIFESTS)} THEN 'full_review'
  WHEN len(list_filter(both_sides, lambda i: NOT {_any_sql('i', scan.COMMENTS)})) = 0 THEN 'auto_approve'
  WHEN len(added) > 0 AND len(removed) > 0 AND list_sort(list_transform(added, lambda i: regexp_replace(i, '\\s+', '', 'g'))) = list_sort(list_transform(removed, lambda i: regexp_replace(i, '\\s+', '', 'g'))) THEN 'auto_approve'
  WHEN {_any_sql('path', scan.TESTS, '(?i)')} AND n <= 50 THEN 'quick_scan'
  WHEN n <= 10 AND len(list_filter(both_sides, lambda i: NOT starts_with(regexp_replace(i, '{ENDS}', '', 'g'), '#') AND NOT starts_with(regexp_replace(i, '{ENDS}', '', 'g'), '//') AND {_any_sql('i', scan.LOGIC)})) = 0 THEN 'auto_approve'
  WHEN n <= 50 THEN 'quick_scan' ELSE 'full_review' END AS decision FROM counted)"""


@registered(f"WITH {TRIAGE_SQL} SELECT * FROM triaged")
def triage_decide(spark, sf_dir):
    return scan.triage(changes(spark, sf_dir)).select("doc_id", "n_changes", "decision")


#: A second policy, of a strict team.
STRICT = {name: dict(keys) for name, keys in policy.DEFAULTS.items()}
STRICT["triage"] |= {"max_lines_for_auto": 3, "max_lines_for_quick": 20, "allow_only_comments": False, "allow_only_formatting": False, "allow_test_files": False, "skip_patterns": [r"\.txt$"], "manifest_patterns": [r"main\.c$"]}
STRICT["security"] |= {"banned_patterns": ["the "], "secret_patterns": [], "block_on_critical": False}
STRICT["gate"] |= {"blocking_severity": "high", "quality_score_threshold": 90, "fail_pipeline_on_quality_below": 70, "fail_pipeline_on_critical": False}
STRICT["quality"] |= {"max_class_methods": 10, "max_function_lines": 50, "max_cyclomatic_complexity": 10, "min_duplicate_lines": 5, "enforce_srp": False, "enforce_dip": False}
STRICT["performance"] |= {"max_nested_loops": 2, "alert_on_n_squared": False, "alert_on_n_plus_one": False, "alert_on_memory_leak": False}


@registered(f"""WITH {TRIAGE_SQL[: TRIAGE_SQL.index('triaged AS')].rstrip().rstrip(',')},
strict AS (SELECT doc_id, n::INT AS n_changes, CASE WHEN {_any_sql('path', STRICT['triage']['skip_patterns'], '(?i)')} THEN 'skip'
  WHEN {_any_sql("array_to_string(added, chr(10))", STRICT['security']['banned_patterns'], '(?i)')} OR {_any_sql('diff', scan.API_CHANGES, '(?m)')} THEN 'critical'
  WHEN {_any_sql('path', STRICT['triage']['manifest_patterns'])} THEN 'full_review'
  WHEN n <= 3 AND len(list_filter(both_sides, lambda i: NOT starts_with(regexp_replace(i, '{ENDS}', '', 'g'), '#') AND NOT starts_with(regexp_replace(i, '{ENDS}', '', 'g'), '//') AND {_any_sql('i', scan.LOGIC)})) = 0 THEN 'auto_approve'
  WHEN n <= 20 THEN 'quick_scan' ELSE 'full_review' END AS decision FROM counted) SELECT * FROM strict""")
def triage_strict(spark, sf_dir):
    """The same changes under the strict policy."""
    return policy.triage(changes(spark, sf_dir), STRICT).select("doc_id", "n_changes", "decision")


@registered(f"WITH {TRIAGE_SQL} SELECT d AS decision, count(doc_id) AS n FROM (SELECT unnest(['skip','auto_approve','quick_scan','full_review','critical']) AS d) LEFT JOIN triaged ON decision = d GROUP BY d")
def triage_summary(spark, sf_dir):
    return rollup.dense_counts(scan.triage(changes(spark, sf_dir)).select("decision"), "decision", list(scan.DECISIONS))


@registered(f"""WITH {CHANGES_SQL}, rows AS (SELECT doc_id, unnest(string_split(diff, chr(10))) AS x, generate_subscripts(string_split(diff, chr(10)), 1) AS pos FROM changes),
k AS (SELECT *, regexp_extract(x, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)', 1) AS header FROM rows),
kinds AS (SELECT *, CASE WHEN header <> '' THEN 'h' WHEN starts_with(x, '+') AND NOT starts_with(x, '+++') THEN 'a' WHEN starts_with(x, '-') THEN 'd' WHEN starts_with(x, '+') OR starts_with(x, chr(92)) THEN 'o' ELSE 'c' END AS kind, try_cast(header AS BIGINT) AS start FROM k),
h AS (SELECT *, sum((kind = 'h')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS hunk FROM kinds),
p AS (SELECT *, max(start) OVER (PARTITION BY doc_id, hunk ORDER BY pos) + coalesce(sum((kind IN ('a', 'c'))::INT) OVER (PARTITION BY doc_id, hunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM h)
SELECT doc_id, line::BIGINT AS line FROM p WHERE kind = 'a' AND hunk > 0""")
def changed_lines(spark, sf_dir):
    return scan.changed_lines(changes(spark, sf_dir), "doc_id")


def _verdict_sql() -> str:
    return "SELECT conv_id, turn, " + ", ".join(f"regexp_matches(said, {_q('(?i)' + p)}) AS v{i}" for i, p in enumerate(scan.VERDICTS)) + f" FROM ({SAID_SQL})"


# A conversation's turns with, by turn, one of nine claims of a verdict behind each.
CLAIMS = (
    "It was approved.", "The merge request clearly blocks the pipeline.", "This will fail the pipeline", "I am rejecting it", "Approving this change",
    "\\nBlocking the merge", "LGTM, ship  it", "do not merge", "change is approved", "nothing was said",
)
SAID_SQL = "SELECT conv_id, turn, text || ' ' || list_extract([" + ", ".join("'" + c.replace("\\n", "' || chr(10) || '") + "'" for c in CLAIMS) + "], (conv_id + turn) % 10 + 1) AS said FROM conversations"


def said(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    claim = F.element_at(F.array(*[F.lit(x.replace("\\n", "\n")) for x in CLAIMS]), ((F.col("conv_id") + F.col("turn")) % 10 + 1).cast("int"))
    return c.select("conv_id", "turn", F.concat("text", F.lit(" "), claim).alias("said"))


@registered(_verdict_sql())
def verdict_idioms(spark, sf_dir):
    return said(spark, sf_dir).select("conv_id", "turn", *[F.col("said").rlike("(?i)" + p).alias(f"v{i}") for i, p in enumerate(scan.VERDICTS)])


@registered(f"WITH {CHANGES_SQL} SELECT doc_id, regexp_extract(path, '([^/]*)$', 1) AS basename, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, md5(substr(array_to_string(list_concat([regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '')], list_transform(list_filter(string_split(diff, chr(10)), lambda i: starts_with(i, '+') AND NOT starts_with(i, '+++')), lambda i: substr(i, 2))), chr(10)), 1, 2000)) AS query FROM changes")
def change_query(spark, sf_dir):
    c = changes(spark, sf_dir)
    return c.select("doc_id", basename(F.col("path")).alias("basename"), directory(F.col("path")).alias("directory"), F.md5(scan.query_from_change(F.col("path"), F.col("diff")).cast("binary")).alias("query"))


# History ---------------------------------------------------------------------------------------------------------------


def _today(df: DataFrame) -> F.Column:
    return F.lit(df.agg(F.max("last_seen")).first()[0])


@registered(f"WITH {HISTORY_SQL} SELECT kind, file_path, rule_id, first_seen::VARCHAR AS first_seen, last_seen::VARCHAR AS last_seen, severity, occurrences FROM history")
def consolidate(spark, sf_dir):
    return history.consolidate(sightings(spark, sf_dir)).drop("reason").withColumns({c: F.col(c).cast("string") for c in ("first_seen", "last_seen")})


@registered(f"WITH {HISTORY_SQL} SELECT file_path, rule_id, round(salience, 6) AS salience FROM salient WHERE salience >= 0.15")
def salience_forget(spark, sf_dir):
    past = history.consolidate(sightings(spark, sf_dir))
    today = _today(past)
    return history.forget(past, today).select("file_path", "rule_id", F.round(history.salience(today), 6).alias("salience"))


@registered(f"WITH {HISTORY_SQL} SELECT file_path, rule_id, round(salience, 6) AS salience FROM salient ORDER BY salient.salience DESC, kind, file_path, rule_id LIMIT 50")
def retain_top(spark, sf_dir):
    past = history.consolidate(sightings(spark, sf_dir))
    return history.retain(past, _today(past), 50).select("file_path", "rule_id", F.round("salience", 6).alias("salience"))


@registered(f"""WITH {HISTORY_SQL}, files AS (SELECT DISTINCT file_path AS path FROM findings),
both_tiers AS (SELECT path, s.*, 0 AS tier FROM files JOIN salient s ON path = file_path UNION ALL
  SELECT path, s.*, 1 FROM files JOIN salient s ON path <> file_path AND regexp_extract(path, '^(.*)/', 1) = regexp_extract(file_path, '^(.*)/', 1)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY tier, salience DESC, kind, file_path, rule_id)::INT AS place FROM both_tiers)
SELECT path, file_path, rule_id, tier, place FROM ranked WHERE place <= 8""")
def recall_topn(spark, sf_dir):
    past = history.consolidate(sightings(spark, sf_dir))
    paths = past.select(F.col("file_path").alias("path")).distinct()
    return history.recall_for(paths, past, _today(past)).select("path", "file_path", "rule_id", "tier", "place")


@registered(f"WITH {FINDINGS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY rule_id, file_path, line_number ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, event_id) AS n FROM findings) SELECT event_id, rule_id, file_path, line_number, severity FROM r WHERE n = 1")
def dedupe_findings(spark, sf_dir):
    return history.deduplicate_findings(findings(spark, sf_dir).drop("day"), "event_id")


@registered(f"WITH {FINDINGS_SQL}, late AS (SELECT * FROM findings WHERE event_id % 10 = 0), past AS (SELECT file_path, rule_id, count(*) AS n FROM findings WHERE event_id % 10 <> 0 GROUP BY ALL) SELECT event_id, n AS seen_before FROM late LEFT JOIN past USING (file_path, rule_id)")
def recurrence(spark, sf_dir):
    f, s = findings(spark, sf_dir), sightings(spark, sf_dir)
    past = findings(spark, sf_dir).filter("event_id % 10 <> 0").select(F.lit("finding").alias("kind"), "file_path", "rule_id", F.lit(1).cast("long").alias("occurrences"))
    return history.recurrence(f.filter("event_id % 10 = 0"), past).select("event_id", "seen_before")


# Evaluation ------------------------------------------------------------------------------------------------------------

CONFUSION_SQL = "judged AS (SELECT lang, toxic = 1 AS actual, n_chars > 1500 AS predicted FROM labels JOIN documents USING (doc_id)), m AS (SELECT lang, count_if(actual AND predicted) AS tp, count_if(NOT actual AND predicted) AS fp, count_if(actual AND NOT predicted) AS fn FROM judged GROUP BY lang)"


def _judged(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return evaluation.confusion(d, F.col("toxic") == 1, F.col("n_chars") > 1500, "lang")


def _wilson_sql(h: str, n: str, bound: str) -> str:
    z, sign = stats.Z, "-" if bound == "lower" else "+"
    return f"CASE WHEN {n} = 0 THEN {0.0 if bound == 'lower' else 1.0} ELSE greatest(0.0, least(1.0, ({h} / {n}::DOUBLE + {z * z} / (2 * {n}) {sign} {z} * sqrt({h} / {n}::DOUBLE * (1 - {h} / {n}::DOUBLE) / {n} + {z * z} / (4.0 * {n} * {n}))) / (1 + {z * z} / {n}))) END"


@registered(f"WITH {CONFUSION_SQL} SELECT lang, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp)::DOUBLE END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn)::DOUBLE END, 6) AS recall, round({_wilson_sql('tp', '(tp + fp)', 'lower')}, 6) AS p_lower, round({_wilson_sql('tp', '(tp + fp)', 'upper')}, 6) AS p_upper, round(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM m")
def confusion_wilson(spark, sf_dir):
    s = evaluation.scored(_judged(spark, sf_dir))
    return s.select("lang", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall")], F.round("p.lower", 6).alias("p_lower"), F.round("p.upper", 6).alias("p_upper"), F.round("f1", 6).alias("f1"))


@registered(f"WITH {CONFUSION_SQL}, t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM m), b AS (SELECT *, {_wilson_sql('tp', '(tp + fp)', 'lower')} AS p, {_wilson_sql('tp', '(tp + fn)', 'lower')} AS r FROM t) SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(CASE WHEN p <= 0 OR r <= 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1_lower FROM b")
def confusion_total(spark, sf_dir):
    return evaluation.scored(evaluation.total(_judged(spark, sf_dir))).select("tp", "fp", "fn", F.round("f.lower", 6).alias("f1_lower"))


GRADED_SQL = FINDINGS_SQL + """, want AS (SELECT file_path AS c, rule_id, line_number, count(*) AS w FROM findings WHERE event_id % 3 <> 0 GROUP BY ALL), got AS (SELECT file_path AS c, rule_id, line_number, count(*) AS g FROM findings WHERE event_id % 3 <> 1 GROUP BY ALL),
b AS (SELECT rule_id, coalesce(w, 0) AS w, coalesce(g, 0) AS g FROM want FULL JOIN got USING (c, rule_id, line_number))"""


@registered(f"WITH {GRADED_SQL} SELECT rule_id, sum(least(w, g))::BIGINT AS tp, sum(g - least(w, g))::BIGINT AS fp, sum(w - least(w, g))::BIGINT AS fn FROM b GROUP BY rule_id")
def grade_exact(spark, sf_dir):
    f = findings(spark, sf_dir).withColumnRenamed("file_path", "case_name")
    return evaluation.grade_exact(f.filter("event_id % 3 <> 0"), f.filter("event_id % 3 <> 1"))


#: Expectations (with their severity, but for every fifth) claim findings within two lines, case after case, in their order.
TOLERANCE_SQL = "WITH RECURSIVE " + FINDINGS_SQL + """,
want AS (SELECT file_path AS c, list({'r': rule_id, 'l': line_number, 's': CASE WHEN event_id % 5 <> 0 THEN severity END} ORDER BY event_id) AS wants FROM findings WHERE event_id % 3 <> 0 GROUP BY 1),
got AS (SELECT file_path AS c, list({'r': rule_id, 'l': line_number, 's': severity} ORDER BY rule_id, line_number, severity) AS found FROM findings WHERE event_id % 3 <> 1 GROUP BY 1),
barred AS (SELECT file_path AS c, list(DISTINCT {'r': rule_id, 'l': line_number * (event_id % 2)}) AS barred FROM findings WHERE event_id % 50 = 1 GROUP BY 1),
cases AS (SELECT c, coalesce(wants, []) AS wants, coalesce(found, []) AS found, coalesce(barred, []) AS barred FROM (SELECT DISTINCT file_path AS c FROM findings) LEFT JOIN want USING (c) LEFT JOIN got USING (c) LEFT JOIN barred USING (c)),
walk AS (SELECT c, 0 AS n, wants, found AS rest, barred, '' AS verdict, NULL::VARCHAR AS rule FROM cases UNION ALL
  SELECT c, n, wants, CASE WHEN best IS NULL THEN rest ELSE list_filter(rest, lambda x, i: i <> best.i) END, barred, CASE WHEN best IS NULL THEN 'missed' WHEN best.o THEN 'mismatched' ELSE 'matched' END, w.r FROM (
    SELECT c, n + 1 AS n, wants, rest, barred, wants[n + 1] AS w, list_sort(list_filter(list_transform(rest, lambda x, i: {'o': wants[n + 1].s IS NOT NULL AND x.s <> wants[n + 1].s, 'd': abs(x.l - wants[n + 1].l), 'l': x.l, 'i': i, 'on': x.r = wants[n + 1].r}), lambda y: y.on AND y.d <= 2))[1] AS best
    FROM walk WHERE n < len(wants))),
last AS (SELECT c, wants, barred, unnest(rest) AS f FROM walk WHERE n = len(wants)),
verdicts AS (SELECT c, verdict FROM walk WHERE n > 0 UNION ALL
  SELECT c, CASE WHEN len(list_filter(barred, lambda b: b.r = f.r AND (b.l = 0 OR b.l = f.l))) > 0 THEN 'forbidden' WHEN f.r LIKE 'SAST.%' OR len(list_filter(wants, lambda w: w.r = f.r)) > 0 THEN 'spurious' ELSE 'ungraded' END FROM last)
SELECT c AS case_name, verdict, count(*) AS n FROM verdicts GROUP BY ALL"""


@registered(TOLERANCE_SQL)
def grade_tolerance(spark, sf_dir):
    f = findings(spark, sf_dir).withColumnRenamed("file_path", "case_name")
    cases = f.select("case_name").distinct().select("case_name", F.array(F.lit("SAST.*")).alias("scope"), F.lit(2).alias("line_tolerance"))
    barred = f.filter("event_id % 50 = 1").select("case_name", "rule_id", (F.col("line_number") * (F.col("event_id") % 2)).alias("line_number"))
    wants = f.filter("event_id % 3 <> 0").withColumns({"ordinal": F.col("event_id").cast("int"), "severity": F.when(F.col("event_id") % 5 != 0, F.col("severity"))})
    graded = evaluation.grade(wants, f.filter("event_id % 3 <> 1"), barred, cases)
    return graded.groupBy("case_name", "verdict").agg(F.count("*").alias("n"))


@registered("""WITH a AS (SELECT lang AS chk, avg(toxic) AS rate FROM labels JOIN documents USING (doc_id) WHERE doc_id % 2 = 0 GROUP BY lang UNION ALL SELECT 'all before', avg(toxic) FROM labels), b AS (SELECT lang AS chk, avg(toxic) AS rate FROM labels JOIN documents USING (doc_id) WHERE doc_id % 2 = 1 GROUP BY lang UNION ALL SELECT 'all after', avg(toxic) FROM labels)
SELECT chk AS "check", round(b.rate - a.rate, 6) AS delta, CASE WHEN a.rate IS NULL THEN 'unmeasured' WHEN b.rate IS NULL THEN 'gone' WHEN b.rate - a.rate > 1e-9 THEN 'rose' WHEN b.rate - a.rate < -1e-9 THEN 'fell' ELSE 'unchanged' END AS change FROM a FULL JOIN b USING (chk)""")
def baseline_compare(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    rate = lambda x: x.groupBy(F.col("lang").alias("check")).agg(F.avg("toxic").alias("rate"))
    alone = lambda name: table(spark, sf_dir, "labels").agg(F.avg("toxic").alias("rate")).select(F.lit(name).alias("check"), "rate")
    before, after = rate(d.filter("doc_id % 2 = 0")).unionByName(alone("all before")), rate(d.filter("doc_id % 2 = 1")).unionByName(alone("all after"))
    return evaluation.compare(before, after).select("check", F.round("delta", 6).alias("delta"), "change")


# Roll-ups --------------------------------------------------------------------------------------------------------------


@registered(f"WITH {FINDINGS_SQL}, f AS (SELECT DISTINCT file_path FROM findings), s AS (SELECT unnest(['critical','high','medium','low','info']) AS severity) SELECT f.file_path, s.severity, count(x.event_id) AS n FROM f CROSS JOIN s LEFT JOIN findings x ON x.file_path = f.file_path AND x.severity = s.severity GROUP BY ALL")
def severity_counts(spark, sf_dir):
    return rollup.dense_counts(findings(spark, sf_dir), "severity", [s[0] for s in severity.SEVERITIES], "file_path")


WEIGHT_SQL = "CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 0 END"
RANK_SQL = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


@registered(f"""WITH {FINDINGS_SQL}, g AS (SELECT file_path, day, greatest(0, 100 - sum({WEIGHT_SQL})) AS score, min({RANK_SQL}) AS worst, least(100, sum({WEIGHT_SQL})) AS total, count_if(severity = 'critical') AS crit, count_if(severity = 'high') AS high FROM findings GROUP BY ALL)
SELECT file_path, day::VARCHAR AS day, score::BIGINT AS score, list_extract(['critical','high','medium','low','info'], worst + 1) AS worst, total::BIGINT AS risk, CASE WHEN total >= 100 OR crit > 0 THEN 'critical' WHEN total >= 50 OR high >= 3 THEN 'high' WHEN total >= 20 OR high >= 1 THEN 'medium' WHEN total > 0 THEN 'low' ELSE 'safe' END AS level FROM g""")
def risk_levels(spark, sf_dir):
    s = F.col("severity")
    total, level = rollup.risk(s)
    return findings(spark, sf_dir).groupBy("file_path", F.col("day").cast("string").alias("day")).agg(rollup.score(s).alias("score"), rollup.worst_severity(s).alias("worst"), total.alias("risk"), level.alias("level"))


GATE_SQL = FINDINGS_SQL + f""", sel AS (SELECT * REPLACE (file_path || '@' || day AS file_path) FROM findings), files AS (SELECT DISTINCT file_path, user_of % 5 <> 0 AS analysed, user_of % 9 = 0 AS warned FROM (SELECT file_path, regexp_extract(file_path, 'f([0-9]+)', 1)::INT AS user_of FROM sel)),
x AS (SELECT file_path, count(*) AS n, greatest(0, 100 - sum({WEIGHT_SQL})) AS q, count_if(severity = 'critical') AS b, count_if(severity IN ('high', 'medium')) AS w FROM sel GROUP BY file_path),
g AS (SELECT f.*, CASE WHEN analysed THEN coalesce(n, 0) END AS n_findings, CASE WHEN analysed THEN coalesce(q, 100) END AS quality, coalesce(b, 0) AS b, coalesce(w, 0) AS w FROM files f LEFT JOIN x USING (file_path)),
gated AS (SELECT file_path, n_findings::BIGINT AS n_findings, quality::BIGINT AS quality, CASE WHEN analysed AND (b > 0 OR quality < 50) THEN 'fail' WHEN warned OR (analysed AND (w > 0 OR quality < 60)) THEN 'warn' ELSE 'pass' END AS result FROM g)"""


def daily(spark, sf_dir):
    """Findings whose file is a file's state of one day, so that scores do not all end at 0."""
    return findings(spark, sf_dir).withColumn("file_path", F.concat("file_path", F.lit("@"), F.col("day").cast("string")))


def _gates(spark, sf_dir):
    f = daily(spark, sf_dir)
    user = F.regexp_extract("file_path", "f([0-9]+)", 1).cast("int")
    files = f.select("file_path").distinct().select("file_path", (user % 5 != 0).alias("analysed"), F.lit(False).alias("prose_blocks"), (user % 9 == 0).alias("prose_warns"))
    return files, rollup.gate(files, f)


@registered(f"WITH {GATE_SQL} SELECT * FROM gated")
def gate_files(spark, sf_dir):
    return _gates(spark, sf_dir)[1]


#: What reviews say, by user: nothing, a failed scan, a risk, scores, breaking changes.
TOLD = ("", "- **SAST Scan Result**: [FAIL - high]", "**Risk Assessment**: [Critical]", "**SOLID Compliance**: 95/100", "**SOLID Compliance**: [80/100]\nBreaking Changes**: Yes", "**SOLID Compliance**: 40/100", "sast scan result: pass")


def _told_gate_sql(p: policy.Policy) -> str:
    """The gate of the files of each day, with the reviews of TOLD, under a policy."""
    bar = ("critical", "high", "medium", "low", "info").index(p["gate"]["blocking_severity"])
    blocking = ", ".join(f"'{s}'" for s in ("critical", "high", "medium", "low", "info")[: bar + 1])
    warning = ", ".join(f"'{s}'" for s in ("high", "medium") if s not in blocking) or "''"
    on, below, fail = p["gate"]["fail_pipeline_on_critical"], p["gate"]["quality_score_threshold"], p["gate"]["fail_pipeline_on_quality_below"]
    return "WITH " + FINDINGS_SQL + f""", sel AS (SELECT * REPLACE (file_path || '@' || day AS file_path) FROM findings),
r AS (SELECT DISTINCT file_path, u % 5 <> 0 AS analysed, u % {len(TOLD)} AS t FROM (SELECT file_path, regexp_extract(file_path, 'f([0-9]+)', 1)::INT AS u FROM sel)),
x AS (SELECT file_path, count(*) AS n, greatest(0, 100 - sum({WEIGHT_SQL})) AS q, count_if(severity IN ({blocking})) AS b, count_if(severity IN ({warning})) AS w FROM sel GROUP BY file_path),
g AS (SELECT r.*, CASE WHEN analysed THEN n END AS n_findings, CASE WHEN analysed THEN q WHEN t = 3 THEN 95 WHEN t = 4 THEN 80 WHEN t = 5 THEN 40 END AS quality, b, w FROM r JOIN x USING (file_path))
SELECT file_path, n_findings::BIGINT AS n_findings, quality::BIGINT AS quality, CASE
  WHEN (NOT analysed AND (t = 1 OR (t = 2 AND {on}))) OR (analysed AND b > 0) OR (quality < {below} AND quality < {fail}) THEN 'fail'
  WHEN t = 1 OR (t = 2 AND {on}) OR (t = 4 AND {p['security']['block_on_critical']}) OR (NOT analysed AND quality IS NULL) OR (analysed AND w > 0) OR quality < {below} THEN 'warn' ELSE 'pass' END AS result FROM g"""


def _reviews(spark, sf_dir):
    f = daily(spark, sf_dir)
    user = F.regexp_extract("file_path", "f([0-9]+)", 1).cast("int")
    review = F.element_at(F.array(*map(F.lit, TOLD)), user % len(TOLD) + 1)
    return f.select("file_path").distinct().select("file_path", (user % 5 != 0).alias("analysed"), review.alias("review")), f


@registered(_told_gate_sql(policy.DEFAULTS))
def gate_reviews(spark, sf_dir):
    return policy.gate(*_reviews(spark, sf_dir), policy.DEFAULTS)


@registered(_told_gate_sql(STRICT))
def gate_strict(spark, sf_dir):
    return policy.gate(*_reviews(spark, sf_dir), STRICT)


@registered(f"WITH {GATE_SQL} SELECT CASE max(CASE result WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS result FROM (SELECT result FROM gated UNION ALL SELECT 'fail' FROM files WHERE NOT analysed)")
def verdict_lattice(spark, sf_dir):
    files, gates = _gates(spark, sf_dir)
    return rollup.outcome(gates, files.filter("false"), files.filter("not analysed"))


METRICS_SQL = """f AS (SELECT o_custkey % 100 AS project_id, o_orderkey, sum(l_quantity)::BIGINT AS lines_analyzed, sum(l_linenumber)::BIGINT AS duration_ms, count(*) AS recurring_findings, CASE max(l_returnflag) WHEN 'R' THEN 'fail' WHEN 'N' THEN 'warn' ELSE 'pass' END AS gate_result, CASE WHEN max(l_linenumber) > 2 THEN min(l_discount) END AS quality_score FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


def _file_metrics(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber", "l_returnflag", "l_discount")
    flag = F.max("l_returnflag")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy((F.col("o_custkey") % 100).alias("project_id"), "o_orderkey").agg(
        F.sum("l_quantity").cast("long").alias("lines_analyzed"), F.sum("l_linenumber").alias("duration_ms"), F.count("*").alias("recurring_findings"),
        F.when(flag == "R", "fail").when(flag == "N", "warn").otherwise("pass").alias("gate_result"), F.when(F.max("l_linenumber") > 2, F.min("l_discount")).alias("quality_score"),
    )


@registered(f"WITH {METRICS_SQL} SELECT project_id, count(*) AS files_analyzed, sum(lines_analyzed)::BIGINT AS lines_analyzed, sum(duration_ms)::BIGINT AS duration_ms, max(duration_ms) AS slowest_file_ms, sum(recurring_findings)::BIGINT AS recurring_findings, CASE max(CASE gate_result WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS gate_result, min(quality_score) AS quality_score FROM f GROUP BY project_id")
def metrics_rollup(spark, sf_dir):
    return rollup.metrics(_file_metrics(spark, sf_dir), "project_id")


@registered(f"""WITH {METRICS_SQL}, t AS (SELECT project_id, sum(lines_analyzed)::BIGINT AS v FROM f GROUP BY project_id)
SELECT 'lines_analyzed{{project_id="' || project_id || '"}} ' || v AS line FROM t UNION ALL SELECT '# HELP lines_analyzed Lines read.' UNION ALL SELECT '# TYPE lines_analyzed counter'""")
def prometheus_export(spark, sf_dir):
    m = rollup.metrics(_file_metrics(spark, sf_dir), "project_id")
    totals = m.select(F.lit("lines_analyzed").alias("name"), F.create_map(F.lit("project_id"), F.col("project_id").cast("string")).alias("labels"), F.col("lines_analyzed").alias("value"))
    return rollup.prometheus(totals, {"lines_analyzed": ("Lines read.", "counter")})


@registered("SELECT o_orderpriority AS agent, count(*) AS runs, count_if(o_orderstatus = 'F') AS failures, sum(o_custkey)::BIGINT AS tokens FROM orders GROUP BY ALL")
def agent_totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("agent"), (F.col("o_orderstatus") == "F").alias("failed"), F.lit(0).alias("tool_calls"), F.col("o_custkey").alias("tokens"), F.lit(0).alias("duration_ms"))
    return rollup.agent_totals(o).select("agent", "runs", "failures", "tokens")


# Lookup joins ----------------------------------------------------------------------------------------------------------

DIRECTIVE_SQL = "dir(rule, whole, line, file_level) AS (VALUES ('SAST.XSS', false, 7, false), ('SAST', true, 20, false), ('QUALITY', true, 0, true), ('DOCS.DEAD_REFERENCE', false, 3, false))"


@registered(f"""WITH {FINDINGS_SQL}, {DIRECTIVE_SQL}, hit AS (SELECT event_id, CASE WHEN whole THEN rule || '.*' ELSE rule END AS d, row_number() OVER (PARTITION BY event_id ORDER BY file_level DESC, line) AS n
  FROM findings JOIN dir ON (file_level OR line = line_number) AND (CASE WHEN whole THEN split_part(rule_id, '.', 1) = rule ELSE rule_id = rule END))
SELECT f.event_id, d AS directive FROM findings f LEFT JOIN (SELECT * FROM hit WHERE n = 1) h ON h.event_id = f.event_id""")
def suppression_join(spark, sf_dir):
    f = findings(spark, sf_dir)
    text = "x = 1  # review-ignore-file: QUALITY.* - generated\n\ny = 2  # review-ignore: DOCS.DEAD_REFERENCE\n\n\n# review-ignore: SAST.XSS - escaped\nz = 3\n" + "\n" * 12 + "w = 4  // review-ignore: SAST.*: legacy"
    files = f.select("file_path").distinct().withColumn("content", F.lit(text))
    return joins.suppress(f, joins.directives(files), "event_id").select("event_id", "directive")


CONTROLS = (("AC-1", ["SAST", "SECRETS"]), ("QA-2", ["QUALITY", "PERFORMANCE"]), ("DR-3", ["RESILIENCE"]))
CONTROL_SQL = "ctl(control, ns) AS (VALUES ('AC-1', 'SAST'), ('AC-1', 'SECRETS'), ('QA-2', 'QUALITY'), ('QA-2', 'PERFORMANCE'), ('DR-3', 'RESILIENCE')), c AS (SELECT split_part(rule_id, '.', 1) AS ns, count(*) AS n FROM findings GROUP BY 1)"


@registered(f"WITH {FINDINGS_SQL}, {CONTROL_SQL} SELECT control, count(*) AS namespaces, coalesce(sum(n), 0)::BIGINT AS n_findings FROM ctl LEFT JOIN c USING (ns) GROUP BY control")
def control_coverage(spark, sf_dir):
    return joins.control_coverage(spark.createDataFrame(list(CONTROLS), "control string, namespaces array<string>"), findings(spark, sf_dir))[0]


@registered(f"WITH {FINDINGS_SQL}, {CONTROL_SQL} SELECT ns AS namespace, n AS n_findings FROM c WHERE ns NOT IN (SELECT ns FROM ctl)")
def unmapped_namespaces(spark, sf_dir):
    return joins.control_coverage(spark.createDataFrame(list(CONTROLS), "control string, namespaces array<string>"), findings(spark, sf_dir))[1]


@registered(f"WITH {FINDINGS_SQL} SELECT event_id, CASE split_part(rule_id, '.', 1) WHEN 'SAST' THEN 'sast' WHEN 'QUALITY' THEN 'quality' ELSE 'agent' END AS producer, split_part(rule_id, '.', 1) IN ('SAST', 'QUALITY') AS may_block FROM findings")
def attribution(spark, sf_dir):
    return joins.attribute(findings(spark, sf_dir), spark.createDataFrame([("SAST", "sast"), ("QUALITY", "quality")], "namespace string, producer string")).select("event_id", "producer", "may_block")


EDGES_SQL = "e AS (SELECT DISTINCT a.l_suppkey AS source, b.l_suppkey AS target FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey)"


@registered(f"""WITH {EDGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target) AS n FROM e), one AS (SELECT source AS root, target FROM r WHERE n <= 50),
s AS (SELECT root, one.target AS via, r.target AS target FROM one JOIN r ON r.source = one.target WHERE r.n <= 6 AND r.target <> root), k AS (SELECT *, row_number() OVER (PARTITION BY root, via ORDER BY target) AS m FROM s)
SELECT root, target, 1 AS hop FROM one UNION ALL SELECT root, target, 2 FROM k WHERE m <= 5""")
def ripple_two_hop(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    nxt = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("target"))
    edges = li.join(nxt, ["l_orderkey", "l_linenumber"]).select(F.col("l_suppkey").alias("source"), "target").filter("source <> target").distinct()
    return joins.ripple(edges)


#: Whole words, parts of words, qualified names; the last three may not be searched.
SYMBOLS = ("the", "der", "les", "que", "an", "th", "e", "the.", "a.b", "-x", "two words", "..")
USAGE_SQL = rf"""sym AS (SELECT DISTINCT lower(n_name) AS symbol FROM nation UNION SELECT unnest([{', '.join(f"'{s}'" for s in SYMBOLS[:-3])}])),
l AS (SELECT 'src/m' || doc_id || '.py' AS path, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line FROM documents WHERE NOT contains(text, chr(0))),
e AS (SELECT symbol, '\Q' || symbol || '\E' AS s, path, line, body, row_number() OVER (PARTITION BY symbol, path ORDER BY line) AS m FROM l, sym WHERE regexp_matches(symbol, '^[A-Za-z0-9_][A-Za-z0-9_.:/-]*$') AND contains(body, symbol)),
h AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY path, line) AS n FROM e WHERE m <= 200),
u AS (SELECT symbol, path, line, CASE WHEN regexp_matches(body, '^\s*(?:import|from)\s') THEN 'import' WHEN regexp_matches(body, 'class\s+\w+\s*\([^)]*\b' || s || '\b') THEN 'inheritance' WHEN regexp_matches(body, '\b' || s || '\s*\(') THEN 'call'
  WHEN regexp_matches(body, ':\s*[^=]*\b' || s || '\b') OR regexp_matches(body, '->\s*[^:]*\b' || s || '\b') THEN 'type' ELSE 'data_structure' END AS usage FROM h WHERE n <= 50)"""


def _usages(spark, sf_dir):
    extra = spark.createDataFrame([(s,) for s in SYMBOLS], "symbol string")
    symbols = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("symbol")).union(extra).distinct()
    path = F.concat(F.lit("src/m"), F.col("doc_id").cast("string"), F.lit(".py"))
    return joins.usages(symbols, spread(table(spark, sf_dir, "documents")).select(path.alias("path"), F.col("text").alias("content")))


@registered(f"WITH {USAGE_SQL} SELECT * FROM u")
def symbol_usages(spark, sf_dir):
    return _usages(spark, sf_dir).select("symbol", "path", "line", "usage")


@registered(f"WITH {USAGE_SQL} SELECT symbol, count(DISTINCT path) AS files, CASE WHEN count(DISTINCT path) > 10 THEN 'critical' WHEN count(DISTINCT path) > 5 THEN 'high' WHEN count(DISTINCT path) > 2 THEN 'medium' ELSE 'low' END AS risk FROM u GROUP BY symbol")
def structure_impact(spark, sf_dir):
    return joins.impact(_usages(spark, sf_dir))


@registered(f"WITH {USAGE_SQL}, c AS (SELECT symbol, usage, count(*) AS n FROM u GROUP BY ALL) SELECT symbol, usage, n, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, usage)::INT AS place FROM c")
def impact_summary(spark, sf_dir):
    return joins.impact_summary(_usages(spark, sf_dir))


# Traces ----------------------------------------------------------------------------------------------------------------


@registered(f"WITH {SPANS_SQL} SELECT trace_id, span_id, parent, anomaly FROM tree")
def trace_tree(spark, sf_dir):
    return trace.resolved(spans(spark, sf_dir)).select("trace_id", "span_id", "parent", "anomaly")


SELF_SQL = SPANS_SQL + ", inside AS (SELECT trace_id, parent AS span_id, sum(coalesce(ended_ms - started_ms, 0)) AS s FROM tree WHERE parent IS NOT NULL GROUP BY ALL), timed AS (SELECT tree.*, CASE WHEN ended_ms IS NOT NULL THEN greatest(0, ended_ms - started_ms - coalesce(s, 0)) END::BIGINT AS self_ms FROM tree LEFT JOIN inside USING (trace_id, span_id))"


@registered(f"WITH {SELF_SQL} SELECT trace_id, span_id, self_ms FROM timed")
def self_time(spark, sf_dir):
    return trace.self_time(trace.resolved(spans(spark, sf_dir))).select("trace_id", "span_id", "self_ms")


@registered(f"WITH {SELF_SQL} SELECT kind, sum(self_ms)::BIGINT AS self_ms FROM timed WHERE self_ms IS NOT NULL GROUP BY kind")
def time_by_kind(spark, sf_dir):
    return trace.by_kind(trace.self_time(trace.resolved(spans(spark, sf_dir))))


@registered("WITH RECURSIVE " + SPANS_SQL + """, heir AS (SELECT * FROM (SELECT trace_id, parent, span_id, row_number() OVER (PARTITION BY trace_id, parent ORDER BY coalesce(ended_ms - started_ms, 0) DESC, started_ms, span_id) AS n FROM tree WHERE parent IS NOT NULL) WHERE n = 1),
walk AS (SELECT trace_id, 1 AS step, span_id FROM tree WHERE parent IS NULL UNION ALL SELECT w.trace_id, step + 1, h.span_id FROM walk w JOIN heir h ON h.trace_id = w.trace_id AND h.parent = w.span_id)
SELECT trace_id, step, span_id FROM walk""")
def critical_path(spark, sf_dir):
    return trace.critical_path(trace.resolved(spans(spark, sf_dir)))


# Chains ----------------------------------------------------------------------------------------------------------------

CHAIN_SQL = f"""RECURSIVE rec AS (SELECT user_id, event_id, '{{"event_id":' || event_id || ',"kind":"' || event_type || '"}}' AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
sealed AS (SELECT user_id, event_id, n, payload, '{chain.GENESIS}' AS previous, sha256('{chain.GENESIS}' || chr(10) || n || chr(10) || payload) AS digest FROM rec WHERE n = 1
  UNION ALL SELECT r.user_id, r.event_id, r.n, r.payload, s.digest, sha256(s.digest || chr(10) || r.n || chr(10) || r.payload) FROM sealed s JOIN rec r ON r.user_id = s.user_id AND r.n = s.n + 1)"""


def _sealed(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"kind":"'), "event_type", F.lit('"}')).alias("payload"))
    return chain.seal(spread(e), "user_id", "event_id", "payload", "sha256")


@registered(f"WITH {CHAIN_SQL} SELECT user_id, event_id, n AS sequence, previous, digest FROM sealed")
def chain_seal(spark, sf_dir):
    return _sealed(spark, sf_dir).select("user_id", "event_id", "sequence", "previous", "digest")


@registered(f"""WITH {CHAIN_SQL}, kept AS (SELECT user_id, event_id, n, previous, digest, CASE WHEN user_id % 3 = 0 AND n = 4 THEN '{{"edited":true}}' ELSE payload END AS payload FROM sealed WHERE NOT (user_id % 3 = 1 AND n = 3)),
p AS (SELECT *, row_number() OVER w AS place, coalesce(lag(digest) OVER w, '{chain.GENESIS}') AS before FROM kept WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT *, CASE WHEN previous <> before THEN 'link' WHEN n <> place THEN 'sequence' WHEN digest <> sha256(previous || chr(10) || n || chr(10) || payload) THEN 'digest' END AS reason FROM p)
SELECT user_id, count(*) AS n, CASE WHEN count(reason) = 0 THEN 'intact' ELSE 'tampered' END AS status, (min(place) FILTER (reason IS NOT NULL))::INT AS broken_at, arg_min(reason, place) FILTER (reason IS NOT NULL) AS reason FROM c GROUP BY user_id""")
def chain_verify(spark, sf_dir):
    return verified(spark, sf_dir).drop("signed", "unheld")


def verified(spark, sf_dir):
    """Chains of which a third lost a record, and a third has an edited one."""
    s = _sealed(spark, sf_dir).filter(~((F.col("user_id") % 3 == 1) & (F.col("sequence") == 3)))
    edited = s.withColumn("payload", F.when((F.col("user_id") % 3 == 0) & (F.col("sequence") == 4), '{"edited":true}').otherwise(F.col("payload")))
    return chain.verify(edited, "user_id", "event_id", algorithm="sha256")


@registered("SELECT event_id, CASE WHEN user_id % 10 = 0 AND ts < TIMESTAMP '2024-01-05' THEN '{\"tombstone\":{\"policy\":\"p1\",\"removed_at\":\"2024-06-01\"}}' ELSE props END AS payload FROM events")
def erase_records(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("stamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    chosen = (F.col("user_id") % 10 == 0) & chain.is_older(F.col("stamp"), F.lit("2024-01-05").cast("timestamp"))
    return chain.erase(e.select("event_id", "user_id", "stamp", F.col("props").alias("payload")), chosen, "p1", "2024-06-01").select("event_id", "payload")


@registered("SELECT conv_id, substr(sha256(string_agg(text, chr(10) ORDER BY turn)), 1, 12) AS fingerprint FROM conversations GROUP BY conv_id")
def prompt_fingerprint(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("t"))
    return c.select("conv_id", chain.fingerprint(F.col("t")).alias("fingerprint"))


# Routing ---------------------------------------------------------------------------------------------------------------


@registered("""WITH w AS (SELECT n_regionkey AS grp, n_nationkey AS ord, 1 + length(n_name) % 5 AS weight, 40 + 3 * n_regionkey AS total FROM nation),
q AS (SELECT *, (total - count(*) OVER g) * weight / (sum(weight) OVER g)::DOUBLE AS quota FROM w WINDOW g AS (PARTITION BY grp)),
b AS (SELECT *, 1 + floor(quota)::BIGINT AS base FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(floor(quota) - quota, 9), -weight, ord) AS n, total - sum(base) OVER (PARTITION BY grp) AS rest FROM b)
SELECT grp, ord, (base + CASE WHEN n <= rest THEN 1 ELSE 0 END)::BIGINT AS share FROM r""")
def budget_split(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("ord"), (1 + F.length("n_name") % 5).alias("weight"), (40 + 3 * F.col("n_regionkey")).alias("total"))
    return routing.split_budget(n, "grp", "ord", "weight", "total").select("grp", "ord", "share")


@registered(f"""WITH {FINDINGS_SQL}, c AS (SELECT file_path, bool_or(rule_id LIKE 'SAST.%') AS s, bool_or(rule_id LIKE 'PERFORMANCE.%') AS p FROM (SELECT file_path || '@' || day AS file_path, rule_id FROM findings) GROUP BY file_path)
SELECT file_path, 'architecture' || CASE WHEN s THEN ',security' ELSE '' END || CASE WHEN p THEN ',performance' ELSE '' END AS specialists FROM c""")
def assignments(spark, sf_dir):
    f = daily(spark, sf_dir).select("file_path", F.when(F.col("rule_id").startswith("SAST"), "security").when(F.col("rule_id").startswith("PERF"), "performance").otherwise("quality").alias("category"))
    return routing.plan_assignments(f, f.select("file_path").distinct().withColumn("is_manifest", F.lit(False))).select("file_path", F.array_join("specialists", ",").alias("specialists"))


@registered("""WITH t AS (SELECT greatest(0, count(*) - 12000) AS excess FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus IN ('F', 'P'))
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM r, t WHERE n <= excess)""")
def retain_jobs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("state"), "o_orderdate")
    return routing.forget_old(o, 12000, "state", ("F", "P"), [F.col("o_orderdate"), F.col("key")]).select(F.col("key").alias("o_orderkey"))


# Added: claims and narration scores ------------------------------------------------------------------------------------


AGREED_SQL = "r AS (SELECT conv_id AS case_name, role AS chk, length(text) > 200 AS passed, turn % 2 = 1 AS expected FROM conversations), a AS (SELECT *, passed <> expected AS agrees FROM r)"


def _agreed(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return evaluation.check_agreement(c.select(F.col("conv_id").alias("case_name"), F.col("role").alias("check"), (F.length("text") > 200).alias("passed"), (F.col("turn") % 2 == 1).alias("expect_failure")))


@registered(f"WITH {AGREED_SQL}, c AS (SELECT case_name, bool_and(agrees) AS whole, count(*) AS n, count_if(agrees) AS ok FROM a GROUP BY 1), t AS (SELECT sum(ok) / sum(n)::DOUBLE AS score, count(*) AS cases, count_if(whole) AS whole FROM c) SELECT round(score, 6) AS score, cases, whole, round({_wilson_sql('whole', 'cases', 'lower')}, 6) AS lower FROM t")
def narration_score(spark, sf_dir):
    return evaluation.narration_score(_agreed(spark, sf_dir)).select(F.round("score", 6).alias("score"), "cases", "whole", F.round("interval.lower", 6).alias("lower"))


@registered(f"WITH {AGREED_SQL}, k AS (SELECT unnest(['user', 'assistant', 'tool']) AS chk) SELECT k.chk AS \"check\", coalesce(count_if(passed), 0) AS passing, coalesce(count_if(NOT passed), 0) AS firing, round(avg(agrees::INT), 6) AS rate FROM k LEFT JOIN a ON a.chk = k.chk GROUP BY k.chk")
def check_coverage(spark, sf_dir):
    return evaluation.check_coverage(_agreed(spark, sf_dir), ["user", "assistant", "tool"]).select("check", "passing", "firing", F.round("rate", 6).alias("rate"))


@registered("""WITH h AS (SELECT n_name AS heading FROM nation WHERE n_nationkey % 2 = 0), c AS (SELECT n_name AS heading FROM nation WHERE n_nationkey % 3 = 0), d AS (SELECT n_name AS heading FROM nation WHERE n_nationkey % 5 = 1 AND n_nationkey % 3 <> 0)
SELECT n_name AS heading, CASE WHEN n_name IN (FROM h) AND n_name IN (FROM d) THEN 'declined' WHEN n_name IN (FROM h) AND n_name IN (FROM c) THEN 'graded' WHEN n_name IN (FROM h) THEN 'ungoverned' ELSE 'ungrounded' END AS state FROM nation WHERE n_name IN (FROM h) OR n_name IN (FROM c) OR n_name IN (FROM d)""")
def prompt_alignment(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("heading"))
    return evaluation.alignment(n.filter("n_nationkey % 2 = 0"), n.filter("n_nationkey % 3 = 0"), n.filter("n_nationkey % 5 = 1 and n_nationkey % 3 <> 0"))


MEMORY_TAGS = ("SECURITY", "BREAKING", "CRITICAL", "RISK", "DEPENDENCY", "AFFECTED_CODE", "PERFORMANCE", "PATTERN", "QUALITY", "TODO", "GENERAL", "other")
MEMORY_SQL = f"""told AS (SELECT '[' || list_extract([{', '.join(f"'{t}'" for t in MEMORY_TAGS)}], line_number % 12 + 1) || '] ' || rule_id || ':' || line_number AS content, event_id AS seen, line_number FROM findings WHERE line_number % 13 <> 0 UNION ALL SELECT rule_id || ':' || line_number, event_id, 99 FROM findings WHERE line_number % 13 = 0),
memory AS (SELECT content, min(seen) AS seen, CASE WHEN any_value(line_number) = 99 THEN 'low' WHEN any_value(line_number) % 12 < 3 THEN 'critical' WHEN any_value(line_number) % 12 < 6 THEN 'high' WHEN any_value(line_number) % 12 IN (6, 7, 8, 11) THEN 'normal' ELSE 'low' END AS bucket FROM told GROUP BY content)"""


def memory(spark, sf_dir):
    line, plain = F.col("line_number"), F.concat("rule_id", F.lit(":"), F.col("line_number").cast("string"))
    tag = F.element_at(F.array(*[F.lit(t) for t in MEMORY_TAGS]), line % 12 + 1)
    told = findings(spark, sf_dir).select(F.when(line % 13 != 0, F.concat(F.lit("["), tag, F.lit("] "), plain)).otherwise(plain).alias("content"), F.col("event_id").alias("at"))
    return routing.remember(told)


@registered(f"WITH {FINDINGS_SQL}, {MEMORY_SQL} SELECT count_if(bucket = 'critical') AS critical, count_if(bucket = 'high') AS high, count_if(bucket = 'normal') AS normal, count_if(bucket = 'low') AS low, round(100 * sum(length(content) // 4) / 1000.0, 2) AS used_percent FROM memory")
def memory_buckets(spark, sf_dir):
    return routing.memory_stats(memory(spark, sf_dir), 1000)
