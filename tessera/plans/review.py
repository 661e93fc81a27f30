"""More registered queries with their DuckDB twins: analyzers over generated sources, documents, protocols, evaluation, routing, edits."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessera.functions import stats
from tessera.functions.text import LINE_END
from tessera.operators import chain, chunking, code, documentation, evaluation, fixes, history, joins, retrieval, rollup, routing, scan, search, symbols, trace
from tessera.plans.fixtures import FINDINGS_SQL, SPANS_SQL, findings, spans
from tessera.plans import policy
from tessera.plans.queries import AGREED_SQL, CONFUSION_SQL, CONTROLS, MEMORY_SQL, METRICS_SQL, ORACLES, STRICT, _agreed, _file_metrics, _judged, _mmr_sql, _q, _wilson_sql, memory, registered, verified
from tessera.plans.sources import N, SNIPPETS, SOURCES_SQL, TAILS, _rows, source_files
from tessera.session import spread, table
from tessera.sources import checkout, reports, sealed, stores, workspace

# Analyzers over generated sources ---------------------------------------------------------------------------------------

LIMITS = code.BARE_LIMITS
TAILS_SQL = f"tails(tail, change_type, symbols, breaks, break_line, orphans, public) AS (VALUES {_rows([(i, t[2], t[3], len(t[4]), t[4][0][1] if t[4] else 0, len(t[5]), t[6]) for i, t in enumerate(TAILS)])})"
TAIL_FUNCTIONS_SQL = "tail_functions(tail, name, params, signature) AS (VALUES (2, '_lonely', 1, 'def _lonely(q)'), (3, 'resize_it', 2, 'def resize_it(img, size)'))"


@registered(f"""WITH {SOURCES_SQL}, {TAILS_SQL}, found AS (SELECT file_path, rule_id, severity, before + line AS line_number, CASE WHEN s = 26 AND line = 1 THEN 'SAST.WEAK_CRYPTO' END AS directive FROM parts JOIN given USING (s)
  UNION ALL SELECT file_path, 'SEMANTIC.BREAKING_CHANGE', 'high', CASE WHEN break_line > 0 THEN before + break_line ELSE 0 END, NULL FROM ends JOIN tails USING (tail) WHERE breaks > 0
  UNION ALL SELECT file_path, 'SEMANTIC.UNREFERENCED_IN_FILE', 'low', 0, NULL FROM ends JOIN tails USING (tail) WHERE orphans > 0)
SELECT file_path, rule_id, severity, line_number::INT AS line_number, directive FROM found""")
def analyse_sources(spark, sf_dir):
    found, _ = code.analyse_files(source_files(spark, sf_dir).drop("doc_id"), LIMITS)
    return found.select("file_path", "rule_id", "severity", "line_number", "directive")


@registered(f"""WITH {SOURCES_SQL} SELECT file_path, rule_id, severity, (before + line)::INT AS line_number FROM parts JOIN given USING (s)
WHERE rule_id NOT IN ('QUALITY.SOLID_SRP', 'QUALITY.SOLID_DIP', 'PERFORMANCE.HIGH_COMPLEXITY', 'PERFORMANCE.N_PLUS_ONE', 'PERFORMANCE.MEMORY_LEAK')""")
def analyse_strict(spark, sf_dir):
    """The files alone, without their diffs, under a policy that switches rules off."""
    found, _ = code.analyse_files(source_files(spark, sf_dir).drop("doc_id").withColumn("diff", F.lit("")), policy.limits(STRICT))
    return found.select("file_path", "rule_id", "severity", "line_number")


@registered(f"""WITH {SOURCES_SQL}, {TAILS_SQL} SELECT file_path, change_type, symbols::INT AS symbols, breaks::INT AS breaks, orphans::INT AS orphans,
CASE change_type WHEN 'refactor' THEN 40 WHEN 'feature' THEN 50 WHEN 'bugfix' THEN 30 ELSE 60 END + 10 * breaks + 5 * orphans + 5 * public AS risk FROM files JOIN tails USING (tail) WHERE tail > 0""")
def semantic_changes(spark, sf_dir):
    rows = code.analyse_changes(source_files(spark, sf_dir).filter("diff is not null"))
    return rows.select("file_path", "change_type", F.size("symbols").alias("symbols"), F.size("breaks").alias("breaks"), F.size("orphans").alias("orphans"), "risk")


@registered(f"""WITH {SOURCES_SQL}, {TAIL_FUNCTIONS_SQL} SELECT file_path, name, (before + line)::INT AS line, (before + last)::INT AS end_line, complexity::INT AS complexity, params::INT AS params,
CASE WHEN rec = 1 THEN 'O(2^n) or O(n!) - recursive, needs analysis' WHEN loops >= 3 THEN 'O(n³) or worse - ' || loops || ' nested loops' WHEN loops = 2 THEN 'O(n²)' WHEN loops = 1 THEN 'O(n)' ELSE 'O(1) or O(log n)' END AS shape FROM parts JOIN functions USING (s)
UNION ALL SELECT file_path, name, (before + 1)::INT, (before + 2)::INT, 1, params, 'O(1) or O(log n)' FROM ends JOIN tail_functions USING (tail)""")
def function_metrics(spark, sf_dir):
    f = code.facts(source_files(spark, sf_dir)).filter("kind = 'function'")
    m = lambda k: F.element_at("metrics", F.lit(k))
    return f.select(F.col("path").alias("file_path"), "name", "line", "end_line", m("complexity").alias("complexity"), m("params").alias("params"), code.big_o(m("loops"), m("recursive") == 1).alias("shape"))


@registered(f"WITH {SOURCES_SQL} SELECT file_path, greatest(0, 100 - a.q - b.q)::BIGINT AS quality, greatest(0, 100 - a.p - b.p)::BIGINT AS performance FROM files JOIN sizes a ON a.s = s1 JOIN sizes b ON b.s = s2")
def analyzer_scores(spark, sf_dir):
    files = source_files(spark, sf_dir).select("file_path", "content")
    found = code.findings(code.facts(files), LIMITS).drop("ordinal").unionByName(code.line_findings(files, LIMITS).drop("ordinal"))
    of = lambda space: F.when(F.col("rule_id").startswith(space), F.col("severity"))
    scores = found.groupBy("file_path").agg(rollup.penalty_score(of("QUALITY"), rollup.QUALITY_CHARGES).alias("quality"), rollup.penalty_score(of("PERFORMANCE"), rollup.PERFORMANCE_CHARGES, rollup.PERFORMANCE_DEFAULT).alias("performance"))
    return files.select("file_path").join(scores, "file_path", "left").fillna(100, ["quality", "performance"])


@registered(f"WITH {SOURCES_SQL}, k AS (SELECT s, count(*) AS n FROM (SELECT s FROM functions UNION ALL SELECT * FROM (VALUES (19), (20), (21))) GROUP BY s) SELECT file_path, greatest(0, 100 - a.t - b.t)::BIGINT AS score FROM files JOIN sizes a ON a.s = s1 JOIN sizes b ON b.s = s2 WHERE s1 IN (SELECT s FROM k) OR s2 IN (SELECT s FROM k) OR tail >= 2")
def testability_scores(spark, sf_dir):
    return code.testability(code.facts(source_files(spark, sf_dir)), LIMITS).select(F.col("path").alias("file_path"), "score")


@registered(f"""WITH {SOURCES_SQL}, flows(s, name, line, executed_at, evidence) AS (VALUES (3, 'sql', 2, 3, 'SELECT * FROM users WHERE name = '), (5, 'text_b', 2, 4, 'delete from orders where id = '))
SELECT file_path, name, (before + line)::INT AS line, (before + executed_at)::INT AS executed_at, evidence FROM parts JOIN flows USING (s)""")
def taint_flows(spark, sf_dir):
    return code.facts(source_files(spark, sf_dir)).filter("kind = 'sql_taint'").select(F.col("path").alias("file_path"), "name", "line", F.col("end_line").alias("executed_at"), F.col("detail").alias("evidence"))


@registered(f"WITH {SOURCES_SQL} SELECT file_path, count(*) AS n, sum(CASE severity WHEN 'critical' THEN 1 ELSE 0 END)::BIGINT AS critical FROM (SELECT file_path, severity FROM parts JOIN given USING (s) WHERE rule_id LIKE 'SAST.%') GROUP BY file_path")
def security_union(spark, sf_dir):
    """The line rules and the taint pass together, per file."""
    return code.security_findings(source_files(spark, sf_dir).select("file_path", "content")).groupBy("file_path").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"))


DOC_CASES: list[tuple[str, str | None]] = [
    ('def told(a, b):\n    """Do.\n\n    Args:\n        a: one\n        z: gone\n    """\n    return a', "unknown parameter z; undocumented parameter b"),
    ('def fails(a):\n    """Do.\n\n    Raises:\n        ValueError: never\n\n    Returns:\n        nothing\n    """\n    a.work()', "raises nothing; returns nothing"),
    ('def stub(a):\n    """Do.\n\n    Raises:\n        ValueError: by others\n    """', None),
    ('def sphinx(a, *rest):\n    """Do.\n\n    :param a: one\n    :param int rest: more\n    :raises OSError: at times\n    """\n    raise OSError', None),
    ('def yields(self, a):\n    """Do.\n\n    Yields:\n        all\n    """\n    yield a', None),
]


@registered(f"SELECT doc_id, defect FROM documents JOIN (VALUES {_rows([(i, d) for i, (_, d) in enumerate(DOC_CASES)])}) d(k, defect) ON k = doc_id % {len(DOC_CASES)} WHERE defect IS NOT NULL")
def docstring_drift(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"), F.element_at(F.array(*[F.lit(c) for c, _ in DOC_CASES]), (F.col("doc_id") % len(DOC_CASES) + 1).cast("int")).alias("content"))
    return code.facts(d).filter("kind = 'docstring'").select(F.substring_index("path", ".", 1).cast("long").alias("doc_id"), F.col("detail").alias("defect"))


#: Every definition of a file with its lines: those of the snippets (methods under their class, from their decorator on), the classes, the tail's.
DEFINED_SQL = """classes(s, name, last) AS (VALUES (19, 'Service', 5), (20, 'Wide', 12), (21, 'Single', 3)),
defined AS (SELECT file_path, name, before + 1 AS first, before + last AS last FROM parts JOIN classes USING (s)
  UNION ALL SELECT file_path, coalesce(c.name || '.', '') || f.name, before + CASE WHEN s = 21 THEN 2 ELSE line END, before + f.last FROM parts JOIN functions f USING (s) LEFT JOIN classes c USING (s)
  UNION ALL SELECT file_path, name, before + 1, before + 2 FROM ends JOIN tail_functions USING (tail)),
long AS (SELECT file_path, before + CASE WHEN tail < 2 THEN 1 ELSE 2 END AS lines FROM ends)"""


@registered(f"""WITH {SOURCES_SQL}, {TAIL_FUNCTIONS_SQL}, {DEFINED_SQL}, head AS (SELECT l.file_path, coalesce(min(first) - 1, any_value(lines)) AS last FROM long l LEFT JOIN defined d USING (file_path) GROUP BY l.file_path)
SELECT file_path, name, first::INT AS start_line, last::INT AS end_line FROM defined UNION ALL SELECT file_path, '', 1, last::INT FROM head WHERE last > 0""")
def source_chunks(spark, sf_dir):
    cut = chunking.sources(source_files(spark, sf_dir).withColumnRenamed("file_path", "path"))
    return cut.select(F.col("path").alias("file_path"), "name", "start_line", "end_line")


@registered(f"WITH {SOURCES_SQL}, {TAIL_FUNCTIONS_SQL}, i(s, name) AS (VALUES (0, 'os'), (24, 'time')) SELECT file_path AS path, name FROM parts JOIN i USING (s)")
def file_imports(spark, sf_dir):
    return workspace.imports(source_files(spark, sf_dir).select(F.col("file_path").alias("path"), "content"))


#: One file per document, by its id: suffix, comment mark, content ({i}: the id, {k}: its last digit), and (kind, name, params) of what it defines.
#: The document's own text stands in it as a comment.
SYMBOL_FILES: list[tuple[str, str, str, list[tuple[str, str, str | None]]]] = [
    (".py", "# ", "import os\nLIMIT_{k} = 3\nretries: int = 2\nclass Store(Base):\n    kind = 'x'\n    def save(self, item, *, now=None):\n        held = item\n        return os.environ['STORE_HOME']\n    @classmethod\n    def load(cls, path_{i}):\n        return os.getenv('STORE_PATH', 'x')\ndef load(place_{i}, /, mode='r'):\n    return environ.get('MODE')\nparser.add_argument('-v', '--verbose', help='--no')\nother.get('NOT_ENV')\nx.y = '--not-an-option'\n",
     [("class", "Store", None), ("function", "save", "item,now"), ("method", "Store.save", "item,now"), ("function", "load", "place_{i},mode"), ("method", "Store.load", "path_{i}"), ("assigned", "LIMIT_{k}", None), ("assigned", "retries", None), ("assigned", "kind", None),
      ("assigned", "held", None), ("environment", "STORE_HOME", None), ("environment", "STORE_PATH", None), ("environment", "MODE", None), ("option", "-v", None), ("option", "--verbose", None)]),
    (".go", "// ", "package x\nfunc Run(a int) {}\n// func Gone() {}\nfunc (s *Srv) Serve(w W) {}\r\ntype Srv struct{}\nconst Limit = 3\n\tvar inner int\n", [("declaration", n, None) for n in ("Run", "Serve", "Srv", "Limit", "inner")]),
    (".ts", "// ", "export async function fetchAll(x) {}\nexport abstract class Base {}\ninterface Shape {}\nexport type Id = string\nconst mode = 1\n* let hidden = 2\n", [("declaration", n, None) for n in ("fetchAll", "Base", "Shape", "Id", "mode")]),
    (".java", "// ", "public final class App {\n  private static int count(int a) {\n  public List<String> names(int b) {\n  record Pair(int a) {}\n  /* class Gone */\n  return run(1);\n", [("declaration", n, None) for n in ("App", "count", "names", "Pair")]),
    (".jsx", "// ", "function App() {}\nlet state_{k} = 1\nfoo(function inner() {})\n", [("declaration", "App", None), ("declaration", "state_{k}", None)]),
    (".py", "# ", "def broken(:\n", []),
    (".rb", "# ", "class Ruby\n", []),
]
_FILLED = "replace(replace({}, '{{i}}', doc_id::VARCHAR), '{{k}}', (doc_id % 10)::VARCHAR)"
SYMBOLS_SQL = f"""told(k, suffix, kind, name, params) AS (VALUES {_rows([(i, f[0], *t) for i, f in enumerate(SYMBOL_FILES) for t in f[3]])}),
named AS (SELECT 'src/m' || doc_id || suffix AS path, kind, {_FILLED.format('name')} AS name, {_FILLED.format('params')} AS params FROM documents JOIN told ON k = doc_id % {len(SYMBOL_FILES)})"""


def symbol_files(spark, sf_dir):
    d, k = spread(table(spark, sf_dir, "documents")), (F.col("doc_id") % len(SYMBOL_FILES)).cast("int") + 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), k)
    mark = pick([f[1] for f in SYMBOL_FILES])
    own = F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\0"), F.lit("")), F.lit(LINE_END), F.concat(F.lit("\n"), mark))
    filled = F.replace(F.replace(pick([f[2] for f in SYMBOL_FILES]), F.lit("{i}"), F.col("doc_id").cast("string")), F.lit("{k}"), (F.col("doc_id") % 10).cast("string"))
    return d.select(F.concat(F.lit("src/m"), F.col("doc_id").cast("string"), pick([f[0] for f in SYMBOL_FILES])).alias("path"), F.concat(filled, mark, own, F.lit("\n")).alias("content"))


@registered(f"WITH {SYMBOLS_SQL} SELECT kind, name, count(*) AS files FROM named GROUP BY kind, name")
def symbol_names(spark, sf_dir):
    return symbols.names(symbol_files(spark, sf_dir)).groupBy("kind", "name").agg(F.countDistinct("path").alias("files"))


@registered(f"""WITH {SYMBOLS_SQL} SELECT CASE WHEN kind IN ('option', 'environment') THEN kind ELSE 'symbol' END AS kind, name,
  coalesce(arg_max(params, path) FILTER (WHERE kind = 'method'), arg_min(params, path) FILTER (WHERE kind = 'function')) AS params FROM named GROUP BY 1, 2""")
def symbol_signatures(spark, sf_dir):
    return workspace.symbol_index(symbol_files(spark, sf_dir)).withColumn("params", F.array_join("params", ","))


@registered(f"""WITH {SOURCES_SQL}, {TAIL_FUNCTIONS_SQL}, {DEFINED_SQL}, w AS (SELECT file_path, unnest(range(1, lines + 1)) AS line FROM long),
h AS (SELECT file_path, name, before + line AS a, before + last AS b FROM parts JOIN functions USING (s) UNION ALL SELECT file_path, name, before + 1, before + 2 FROM ends JOIN tail_functions USING (tail))
SELECT w.file_path, w.line::INT AS line, name AS "function" FROM w LEFT JOIN h ON h.file_path = w.file_path AND w.line BETWEEN a AND b""")
def containing_function(spark, sf_dir):
    """The function around every line of every file."""
    files = source_files(spark, sf_dir)
    f = code.symbols(code.facts(files)).filter("kind = 'function'").select("path", "name", F.col("line").alias("start"), F.col("end_line").alias("end"))
    lines = files.select(F.col("file_path").alias("path"), F.explode(F.sequence(F.lit(1), F.size(F.split("content", "\n")))).alias("line"))
    return joins.containing(lines, f).select(F.col("path").alias("file_path"), "line", "function")


#: What the analyzers find in the sources: their rules, and what the diffs give.
FOUND_SQL = f"""{SOURCES_SQL}, {TAILS_SQL}, found AS (SELECT file_path, rule_id, severity, before + line AS line FROM parts JOIN given USING (s)
  UNION ALL SELECT file_path, 'SEMANTIC.BREAKING_CHANGE', 'high', CASE WHEN break_line > 0 THEN before + break_line ELSE 0 END FROM ends JOIN tails USING (tail) WHERE breaks > 0
  UNION ALL SELECT file_path, 'SEMANTIC.UNREFERENCED_IN_FILE', 'low', 0 FROM ends JOIN tails USING (tail) WHERE orphans > 0)"""


@registered(f"WITH {FOUND_SQL} SELECT e.rule_id, count(file_path) AS n FROM (SELECT unnest([{', '.join(map(_q, code.emittable_rules()))}]) AS rule_id) e LEFT JOIN found USING (rule_id) GROUP BY e.rule_id")
def emittable_rules(spark, sf_dir):
    """Every rule that can be reported, with the number of its findings in the sources; what is found must be one of them."""
    found, _ = code.analyse_files(source_files(spark, sf_dir).drop("doc_id"), LIMITS)
    rules = spark.createDataFrame([(r,) for r in code.emittable_rules()], "rule_id string")
    counts = found.groupBy("rule_id").agg(F.count("*").alias("n"))
    return rules.join(counts, "rule_id", "full").select("rule_id", F.coalesce("n", F.lit(0)).alias("n"))


@registered(f"""WITH {FOUND_SQL} SELECT * FROM (SELECT file_path, rule_id, line::INT AS line_number, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, file_path, line,
  CASE WHEN rule_id LIKE 'QUALITY.%' THEN replace(split_part(rule_id, '.', 2), '_', ' ') ELSE array_to_string(list_transform(string_split(split_part(rule_id, '.', 2), '_'), lambda w: w[1] || lower(w[2:])), ' ') END)::INT AS place FROM found) WHERE place <= 100""")
def first_findings(spark, sf_dir):
    """The first hundred findings in the order of reports."""
    found, _ = code.analyse_files(source_files(spark, sf_dir).drop("doc_id"), LIMITS)
    best = found.orderBy(*code.in_order()).limit(100)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*code.in_order()))).select("file_path", "rule_id", "line_number", "place")


# Scans ------------------------------------------------------------------------------------------------------------------


@registered("SELECT language, count(*) AS n FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'cpp' WHEN 1 THEN 'javascript' WHEN 2 THEN 'python' WHEN 3 THEN 'python' ELSE 'cpp' END AS language FROM documents) GROUP BY language")
def languages(spark, sf_dir):
    path = F.concat(F.lit("x"), F.element_at(F.array(*[F.lit(x) for x in (".cpp", ".ts", ".py", ".rb", ".h")]), (F.col("doc_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "documents").groupBy(scan.language(path).alias("language")).agg(F.count("*").alias("n"))


@registered(f"WITH {SOURCES_SQL}, o(rule_id, owasp) AS (VALUES {_rows([('SAST.' + k, v) for k, v in scan.OWASP.items()])}) SELECT coalesce(owasp, '') AS owasp, count(*) AS n FROM parts JOIN given USING (s) LEFT JOIN o USING (rule_id) WHERE rule_id LIKE 'SAST.%' AND s NOT IN (3, 5) GROUP BY 1")
def owasp_counts(spark, sf_dir):
    return scan.scan_files(source_files(spark, sf_dir)).groupBy("owasp").agg(F.count("*").alias("n"))


@registered("""SELECT conv_id, turn, len(regexp_extract_all(text, '[.]'))::INT AS n, CASE turn % 3 WHEN 0 THEN 'src/a_b.py:' || (10 + conv_id % 90) || ',lib/c.go:7,src/a_b.py:' || (10 + conv_id % 90) WHEN 1 THEN 'x.ts:' || conv_id ELSE '' END AS places FROM conversations""")
def cited_places(spark, sf_dir):
    """Every citation of a reply, in order, repeats kept."""
    c, line = table(spark, sf_dir, "conversations"), (10 + F.col("conv_id") % 90).cast("string")
    many = F.concat(F.lit("see src/a_b.py:"), line, F.lit(", not http://x.y:80; lib/c.go:7 and src/a_b.py:"), line)
    told = F.when(F.col("turn") % 3 == 0, many).when(F.col("turn") % 3 == 1, F.concat(F.lit("(x.ts:"), F.col("conv_id").cast("string"), F.lit(")"))).otherwise("see a.b")
    places = F.transform(scan.citations(told), lambda p: F.concat_ws(":", p["path"], p["line"].cast("string")))
    return c.select("conv_id", "turn", F.regexp_count("text", F.lit("[.]")).alias("n"), F.array_join(places, ",").alias("places"))


PROMPT = "# Role\ntext\n## 🚨 Security Analysis\n### [Priority] - [Title]\n## Impact  \n#### deep\n## Impact #\n### Code Quality & 'Style'\n"


@registered("SELECT item_id, 'Role|Security Analysis|Impact|Code Quality & ''Style''|Item ' || item_id AS headings, CASE WHEN item_id % 2 = 0 THEN '' ELSE 'never  said' END AS missing, CASE WHEN item_id % 3 = 0 OR item_id % 2 = 0 THEN '' ELSE 'never  said' END AS missing_any FROM benchmark")
def prompt_sections(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit(PROMPT), F.lit("## Item "), F.col("item_id").cast("string"), F.lit("\n"), F.when(F.col("item_id") % 2 == 0, "it was never\nSAID").otherwise("")).alias("prompt"))
    phrases = F.array(F.lit("role text"), F.lit("never  said"))
    return b.select("item_id", F.array_join(scan.demanded_sections(F.col("prompt")), "|").alias("headings"), F.array_join(scan.absent(phrases, F.col("prompt")), "|").alias("missing"), F.array_join(scan.absent(phrases, F.col("prompt"), F.col("item_id") % 3 == 0), "|").alias("missing_any"))


@registered("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'grep_search' END AS name, CASE WHEN turn % 2 = 0 THEN 'user ' || conv_id END AS pattern, CASE WHEN turn % 2 = 0 THEN 'src/' || turn END AS path,
CASE WHEN conv_id % 2 = 0 THEN 'security' ELSE 'performance' END AS handed_to, CASE WHEN conv_id % 2 = 0 THEN 'an — odd query' ELSE '' END AS why, 'before' || chr(10) || chr(10) || 'after' AS rest FROM conversations""")
def agent_protocols(spark, sf_dir):
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    reply = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("thinking\n<tool_call>\n<function=grep_search>\n<parameter=pattern>\nuser "), conv, F.lit("\n</parameter><parameter= path >src/"), turn, F.lit("</parameter></function></tool_call>"))).otherwise("<tool_call><function=x> unclosed")
    prose = F.concat(F.lit("before\n"), F.when(F.col("conv_id") % 2 == 0, "  HANDOFF: security — an — odd query").otherwise("HANDOFF : performance"), F.lit("\nafter"))
    call, (asked, rest) = scan.tool_call(reply), scan.handoffs(prose)
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", call["name"].alias("name"), F.try_element_at(call["arguments"], F.lit("pattern")).alias("pattern"), F.try_element_at(call["arguments"], F.lit("path")).alias("path"), F.get(asked, F.lit(0))["to"].alias("handed_to"), F.get(asked, F.lit(0))["why"].alias("why"), rest.alias("rest"))


@registered("""WITH p AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN '-rf' WHEN 1 THEN 'a/../b' WHEN 2 THEN ' ' WHEN 3 THEN text WHEN 4 THEN ' ' || string_split(text, ' ')[1] || chr(10) ELSE 'pkg.mod::' || conv_id END AS pattern FROM conversations),
t AS (SELECT *, regexp_replace(pattern, '^[\t-\r ]+|[\t-\r ]+$', '', 'g') AS s FROM p)
SELECT conv_id, turn, coalesce(length(s) <= 200 AND NOT contains(s, '..') AND regexp_matches(s, '^[A-Za-z0-9_][A-Za-z0-9_.:/-]*$'), false) AS valid FROM t""")
def valid_searches(spark, sf_dir):
    t, text = F.col("turn") % 6, F.col("text")
    word = F.concat(F.lit(" "), F.split(text, " ")[0], F.lit("\n"))
    pattern = F.when(t == 0, "-rf").when(t == 1, "a/../b").when(t == 2, " ").when(t == 3, text).when(t == 4, word).otherwise(F.concat(F.lit("pkg.mod::"), F.col("conv_id").cast("string")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", search.valid_search(pattern).alias("valid"))


#: Where a document lies, by its id: some places are never searched.
PLACES = ("src/m{}.py", "src/build/m{}.py", "lib/.env", "lib/.env.d{}", "lib/id_m{}", "web/m{}.min.js", "web/m{}.js", "web/Build/m{}.js", "etc/m{}.lock", "etc/m{}.pem.txt")
PLACES_SQL = f"placed AS (SELECT doc_id, text, replace(list_extract([{', '.join(map(_q, PLACES))}], (doc_id % {len(PLACES)} + 1)::INT), '{{}}', doc_id::VARCHAR) AS path, doc_id % {len(PLACES)} IN (0, 6, 7, 9) AS open FROM documents)"


def placed(spark, sf_dir):
    """(doc_id, path, content): the documents as files."""
    d = spread(table(spark, sf_dir, "documents"))
    path = F.element_at(F.array(*map(F.lit, PLACES)), (F.col("doc_id") % len(PLACES) + 1).cast("int"))
    return d.select("doc_id", F.replace(path, F.lit("{}"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


@registered(f"""WITH {PLACES_SQL}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line FROM placed WHERE open),
h AS (SELECT symbol, path, line, body, row_number() OVER (PARTITION BY symbol, path ORDER BY line) AS n FROM l, (VALUES ('the.'), ('an'), ('e')) p(symbol) WHERE contains(body, symbol))
SELECT symbol, path, line, body FROM h WHERE n <= 20""")
def grep_lines(spark, sf_dir):
    patterns = spark.createDataFrame([("the.",), (" an ",), ("e",), ("-e",), ("../e",), ("two words",)], "symbol string")
    return search.search(placed(spark, sf_dir), patterns, per_file=20)


@registered("SELECT doc_id, decision_kind, n FROM (SELECT doc_id, unnest(['kept']) AS decision_kind, 1 AS n FROM documents WHERE FALSE) UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'review' ELSE 'quiet' END, 1 FROM documents")
def triage_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "a.py").otherwise("README.md").alias("path"), F.lit("+eval(x)").alias("diff"))
    review, quiet = scan.triage_split(scan.triage(d))
    return review.select("doc_id", F.lit("review").alias("decision_kind"), F.lit(1).alias("n")).unionByName(quiet.select("doc_id", F.lit("quiet").alias("decision_kind"), F.lit(1).alias("n")))


#: Paths, and whether they are hidden.
PATHS = {
    "a/.env": 1, ".env.prod": 1, "x/id_rsa": 1, "certs/site.pem": 1, ".ssh/config": 0, "src/environment.py": 0, "credentials.json": 0, "credentials/x": 1, "src/keys.py": 0, "a/.netrc/b": 1, "README.md": 0,
    ".envrc": 1, "x/.git/config": 1, ".gitignore": 0, "w/.htpasswd": 1, "s/app.KEYSTORE": 1, "deploy_rsa": 1, "putty/a.ppk": 1, "ID_custom.txt": 1, "my.environment": 0, "id.txt": 0, "k/pem": 0,
}


@registered(f"SELECT event_id, path, hidden, regexp_extract(path, '[^/]*$') AS name FROM events JOIN (VALUES {_rows([(i, p, h) for i, (p, h) in enumerate(PATHS.items())])}) p(k, path, h) ON k = event_id % {len(PATHS)}, (VALUES (0, false), (1, true)) b(v, hidden) WHERE v = h")
def sensitive_paths(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("event_id") % len(PATHS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", path.alias("path"), checkout.is_sensitive(path).alias("hidden"), F.substring_index(path, "/", -1).alias("name"))


#: Files of a checkout by document id: path, and whether the scan lists it. The sixth has a byte that is no UTF-8, the seventh a NUL.
TREE = (
    ("src/{s}/m{i}.py", 1), ("docs/m{i}.md", 0), ("node_modules/p/m{i}.js", 0), ("src/.git/m{i}.py", 0), ("conf/id_{i}.py", 0), ("conf/deploy_rsa/m{i}.go", 0),
    ("lib/m{i}.go", 1), ("lib/m{i}.yaml", 1), ("m{i}.toml", 1), ("web/m{i}.TS", 0), ("lib/a/m{i}.cs", 1), ("src/.tox/m{i}.py", 0),
)
TREE_BYTES = 2000


@registered(f"""WITH f AS (SELECT doc_id % {len(TREE)} AS k, coalesce(text, '') AS t, replace(replace(list_extract([{', '.join(_q(p) for p, _ in TREE)}], (doc_id % {len(TREE)} + 1)::INT), '{{s}}', source), '{{i}}', doc_id::VARCHAR) AS path FROM documents),
listed AS (SELECT *, row_number() OVER (ORDER BY CASE k WHEN 8 THEN 0 WHEN 6 THEN 1 WHEN 7 THEN 1 WHEN 10 THEN 2 ELSE 3 END, path) - 1 AS ordinal, strlen(t) + (k IN (6, 7))::INT > {TREE_BYTES} AS long FROM f WHERE k IN ({', '.join(str(i) for i, (_, on) in enumerate(TREE) if on)})),
cut AS (SELECT *, CASE WHEN long THEN t[:list_max(list_filter(range({TREE_BYTES // 4}, {TREE_BYTES} + 1), lambda n: strlen(t[:n]) <= {TREE_BYTES}))] ELSE t END AS head FROM listed WHERE k <> 7),
c AS (SELECT ordinal, path, head || CASE WHEN (long AND strlen(head) < {TREE_BYTES}) OR (k = 6 AND NOT long) THEN chr(65533) ELSE '' END
  || CASE WHEN long THEN chr(10) || chr(10) || '[... truncated: file is larger than {TREE_BYTES} bytes, only the first {TREE_BYTES} were read ...]' ELSE '' END AS content FROM cut)
SELECT ordinal, path, length(content)::INT AS chars, md5(content) AS digest FROM c WHERE NOT contains(content, chr(0)) AND length(content) - length(replace(content, chr(65533), '')) <= greatest(1.0, length(content) / 100.0)""")
def checkout_scan(spark, sf_dir):
    """The documents written as a tree, one file each, and scanned again."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % len(TREE)
    path = F.element_at(F.array(*[F.lit(p) for p, _ in TREE]), (k + 1).cast("int"))
    path = F.replace(F.replace(path, F.lit("{s}"), F.col("source")), F.lit("{i}"), F.col("doc_id").cast("string"))
    raw = F.coalesce("text", F.lit("")).cast("binary")
    content = F.when(k == 6, F.concat(raw, F.unhex(F.lit("E9")))).when(k == 7, F.concat(F.unhex(F.lit("00")), raw)).otherwise(raw)
    root = _folder(spark, "tree")
    checkout.write_tree(d.select(path.alias("path"), content.alias("content")), root)
    found = workspace.files(spark, root, max_file_bytes=TREE_BYTES)
    return found.select("ordinal", "path", F.length("content").alias("chars"), F.md5(F.col("content").cast("binary")).alias("digest"))


@registered("SELECT DISTINCT source AS name FROM documents")
def folder_entries(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    hidden = spark.createDataFrame([("docs/.env",), ("other/x.md",)], "path string")
    return workspace.entries(files.unionByName(hidden), "docs")


@registered("SELECT 'docs/' || source || '/' || doc_id || '.md' AS path FROM documents WHERE doc_id = 7")
def found_file(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return workspace.find_file(files, "7.md")


@registered("""WITH RECURSIVE f AS (SELECT lang, doc_id, least(length(text), 400) AS size, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents),
w AS (SELECT lang, doc_id, n, CASE WHEN size <= 20000 THEN size ELSE 0 END AS used, size <= 20000 AS ok FROM f WHERE n = 1 UNION ALL
  SELECT f.lang, f.doc_id, f.n, w.used + CASE WHEN w.used + f.size <= 20000 THEN f.size ELSE 0 END, w.used + f.size <= 20000 FROM w JOIN f ON f.lang = w.lang AND f.n = w.n + 1)
SELECT doc_id AS ordinal, CASE WHEN ok THEN length(substr(text, 1, 400)) END::INT AS chars FROM w JOIN documents USING (doc_id)""")
def budgeted_reads(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("group"), F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return chunking.read_within(d, 400, 20000).select("ordinal", F.length("text").alias("chars"))


# Documents against code -------------------------------------------------------------------------------------------------

DOC = "# Guide\nUse `create_app(config)` with `--strict`, `MAX_LINES` and `Renderer.render`.\n\n```python\nx = (\n```\n## More\nCall `render(\"1\", 2)` or `drain`, see `yaml.safe_load`, `N`, `plain words`.\n```\n`not_a_span`\n```\n"
DOC_CLAIMS = [(2, "signature", "create_app", ""), (2, "option", "--strict", "Guide"), (2, "environment", "MAX_LINES", ""), (2, "symbol", "Renderer.render", ""), (4, "example", "", ""), (8, "symbol", "render", ""), (8, "word", "drain", ""), (8, "symbol", "yaml.safe_load", ""), (8, "word", "N", "")]


@registered(f"SELECT doc_id, line::INT AS line, kind, subject, CASE WHEN line < 7 THEN 'Guide' ELSE 'More' END AS heading FROM documents, (VALUES {_rows([c[:3] for c in DOC_CLAIMS])}) c(line, kind, subject)")
def document_claims(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.lit(DOC).alias("t"))
    return documentation.claims(d.withColumn("p", F.col("doc_id").cast("string")), "p", "t").select(F.col("path").cast("long").alias("doc_id"), "line", "kind", "subject", "heading")


DIFFS = (
    "--- a/app.py\n+++ b/app.py\n@@ -1 +1 @@\n-def create_app(config):\n+def create_app(config, worker):",
    "@@ -1,2 +0,0 @@\n-def drain(q):\n-    flag = '--strict'",
    "@@ -1 +1 @@\n-    def render(self):\n+    def render(self, version):\n-LIMIT = 3\n+LIMIT: int = 4",
    "@@ -1 +1 @@\n-async def old_name(x):\n+def new_name(x):",
    "@@ -1 +1 @@\n-def old_name(x):\n+MAX_SIZE = 3",
    "@@ -1 +1 @@\n-environ['MAX_LINES']\n+pass",
)
#: Names removed, names touched, rename, and defects (rule, subject, line) of DOC, for an index that has what INDEX lists.
INDEX = [("symbol", "create_app", ["config", "worker"]), ("symbol", "Renderer.render", ["version"]), ("symbol", "Renderer", None), ("symbol", "render", None), ("option", "--other", None), ("environment", "CI", None)]
SCOPES = (
    ([], ["create_app"], None, [("DOCS.SIGNATURE_MISMATCH", "create_app", 2)]),
    (["--strict", "drain"], ["--strict", "drain"], None, [("DOCS.UNKNOWN_OPTION", "--strict", 2), ("DOCS.DEAD_REFERENCE", "drain", 8)]),
    ([], ["LIMIT", "render"], None, []),
    (["old_name"], ["new_name", "old_name"], ("old_name", "new_name"), []),
    (["old_name"], ["MAX_SIZE", "old_name"], None, []),
    (["MAX_LINES"], ["MAX_LINES"], None, [("DOCS.UNKNOWN_OPTION", "MAX_LINES", 2)]),
)


def _diffs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*[F.lit(x) for x in DIFFS]), (F.col("doc_id") % len(DIFFS) + 1).cast("int")).alias("diff"))


@registered(f"SELECT doc_id, removed, touched, old, new FROM documents JOIN (VALUES {_rows([(i, ','.join(s[0]), ','.join(s[1]), s[2][0] if s[2] else None, s[2][1] if s[2] else None) for i, s in enumerate(SCOPES)])}) s(k, removed, touched, old, new) ON k = doc_id % {len(SCOPES)}")
def change_scopes(spark, sf_dir):
    scope, rename = documentation.scope_of(F.col("diff")), documentation.rename_of(F.col("diff"))
    return _diffs(spark, sf_dir).select("doc_id", F.array_join(scope["removed"], ",").alias("removed"), F.array_join(scope["touched"], ",").alias("touched"), rename["old"].alias("old"), rename["new"].alias("new"))


@registered(f"SELECT DISTINCT lang, 'CI,' || string_agg(DISTINCT t, ',' ORDER BY t) AS touched FROM (SELECT lang, unnest(string_split(touched, ',')) AS t FROM documents JOIN (VALUES {_rows([(i, ','.join(s[1])) for i, s in enumerate(SCOPES)])}) s(k, touched) ON k = doc_id % {len(SCOPES)}) GROUP BY lang")
def merged_scopes(spark, sf_dir):
    rows = _diffs(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("lang", documentation.scope_of(F.col("diff")).alias("s")).select("lang", "s.*")
    merged = documentation.merged_scope(rows, "lang")
    return merged.select("lang", F.concat(F.lit("CI,"), F.array_join("touched", ",")).alias("touched"))


@registered(f"SELECT doc_id AS case_id, rule, subject, line::INT AS line FROM documents JOIN (VALUES {_rows([(i, *d) for i, s in enumerate(SCOPES) for d in s[3]])}) d(k, rule, subject, line) ON k = doc_id % {len(SCOPES)} UNION ALL SELECT doc_id, 'DOCS.BROKEN_EXAMPLE', '', 4 FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'DOCS.SIGNATURE_MISMATCH', 'create_app', 2 FROM documents WHERE doc_id % 5 = 0 AND doc_id % {len(SCOPES)} <> 0")
def documentation_defects(spark, sf_dir):
    """Each document id is a case of its own: its document, its change, the same index; every fifth edits the document too."""
    diffs = _diffs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("case_name"), "diff")
    mark = lambda c: F.concat("case_name", F.lit("\x01"), c)
    claims = documentation.claims(spread(diffs).select("case_name", F.lit(DOC).alias("t")), "case_name", "t").withColumnRenamed("path", "case_name")
    held = spark.createDataFrame(INDEX, "kind string, name string, params array<string>")
    index = diffs.select("case_name").join(F.broadcast(held)).withColumn("name", mark(F.col("name"))).drop("case_name")
    scopes = diffs.select("case_name", documentation.scope_of(F.col("diff")).alias("s"))
    names = lambda side: scopes.select("case_name", F.explode(f"s.{side}").alias("name")).select(mark(F.col("name")).alias("name"))
    asked = claims.withColumns({"path": mark(F.lit("README.md")), "subject": mark(F.col("subject"))})
    found = documentation.defects(asked, index, names("removed"), names("touched"), diffs.filter("cast(case_name as long) % 5 = 0").select(mark(F.lit("README.md")).alias("path")))
    return found.select(F.substring_index("path", "\x01", 1).cast("long").alias("case_id"), "rule", F.substring_index("subject", "\x01", -1).alias("subject"), "line")


@registered("SELECT doc_id, line, body, regexp_replace(body, '\\bthe\\b', 'a', 'g') AS after FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line FROM documents) WHERE regexp_matches(body, '\\bthe\\b')")
def renamed_lines(spark, sf_dir):
    lines = joins.lines_of(spread(table(spark, sf_dir, "documents")), "text", "doc_id")
    return lines.withColumn("after", documentation.renamed_line(F.col("body"), F.lit("the"), F.lit("a"))).filter("after is not null").select("doc_id", "line", "body", "after")


# Narration and evaluation -----------------------------------------------------------------------------------------------

REVIEW_PARTS = ("Security Analysis, semantic change analysis, Impact Analysis, code quality, Performance Analysis.", "", "Severity: critical", "The SQL Injection stands.", "It was approved.")


@registered("SELECT conv_id, turn, (conv_id % 2 = 0) AS required_sections_are_present, (turn % 3 <> 0) AS citations_are_grounded, (turn % 4 <> 0 OR conv_id % 3 = 0) AS severity_claims_are_backed, (conv_id % 3 <> 0 OR turn % 5 = 0 OR turn % 3 = 1) AS severe_findings_are_mentioned, (conv_id % 7 <> 0) AS the_prose_claims_no_verdict FROM conversations")
def narration_checks(spark, sf_dir):
    c, conv, turn = table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn")
    cited = F.when(turn % 3 == 0, "At app.py:41 then.").when(turn % 3 == 1, "At app.py:7 then.").otherwise("Nowhere.")
    parts = [F.when(conv % 2 == 0, REVIEW_PARTS[0]), cited, F.when(turn % 4 == 0, REVIEW_PARTS[2]), F.when(turn % 5 == 0, REVIEW_PARTS[3]), F.when(conv % 7 == 0, REVIEW_PARTS[4])]
    one = F.struct(F.lit("critical").alias("severity"), F.lit("SQL injection").alias("title"), F.lit(7).alias("line"))
    none = F.array().cast("array<struct<severity:string,title:string,line:int>>")
    cases = c.select("conv_id", "turn", F.concat_ws("\n", *parts).alias("review"), F.lit("app.py").alias("file_path"), F.lit(40).alias("line_count"), F.when(conv % 3 == 0, F.array(one)).otherwise(none).alias("findings"))
    return scan.narration_checks(cases).select("conv_id", "turn", *scan.CHECKS)


@registered("SELECT role AS \"check\", count(*) AS n, count_if(passed) AS passed, count_if(conv_id % 5 <> 0) AS stale FROM (SELECT unnest(['citations_are_grounded', 'the_prose_claims_no_verdict', 'severity_claims_are_backed', 'severe_findings_are_mentioned', 'required_sections_are_present']) AS role, conv_id, turn, unnest([true, turn % 2 = 1, true, true, false]) AS passed FROM conversations) GROUP BY role")
def narration_evaluation(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    none = F.array().cast("array<struct<severity:string,title:string,line:int>>")
    cases = c.select(F.concat_ws("-", "conv_id", "turn").alias("case_name"), "conv_id", F.when(F.col("turn") % 2 == 0, "LGTM").otherwise("fine").alias("review"), F.lit("a.py").alias("file_path"), F.lit(1).alias("line_count"), none.alias("findings"), F.when(F.col("conv_id") % 5 == 0, "now").when(F.col("conv_id") % 5 == 1, None).otherwise("then").alias("prompt_fingerprint"), F.array(F.lit("required_sections_are_present")).alias("expect_failures"))
    return evaluation.evaluate_narration(cases, "now").groupBy("check").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.count_if("stale").alias("stale"))


GRADE_ZERO_SQL = FINDINGS_SQL + """, want AS (SELECT file_path AS c, rule_id, line_number, count(*) AS w FROM findings WHERE event_id % 3 <> 0 GROUP BY ALL), got AS (SELECT file_path AS c, rule_id, line_number, count(*) AS g FROM findings WHERE event_id % 3 <> 1 GROUP BY ALL),
b AS (SELECT c, rule_id, line_number, coalesce(w, 0) AS w, coalesce(g, 0) AS g FROM want FULL JOIN got USING (c, rule_id, line_number)),
asked AS (SELECT DISTINCT c, rule_id FROM want),
v AS (SELECT b.rule_id, least(w, g) AS matched, w - least(w, g) AS missed, CASE WHEN b.rule_id = 'DOCS.DEAD_REFERENCE' AND line_number % 4 = 1 THEN g - least(w, g) ELSE 0 END AS forbidden,
  CASE WHEN b.rule_id = 'DOCS.DEAD_REFERENCE' AND line_number % 4 = 1 THEN 0 WHEN b.rule_id LIKE 'SAST.%' OR a.rule_id IS NOT NULL THEN g - least(w, g) ELSE 0 END AS spurious, g - least(w, g) AS extra FROM b LEFT JOIN asked a ON a.c = b.c AND a.rule_id = b.rule_id)"""


def _graded(spark, sf_dir):
    f = findings(spark, sf_dir).withColumnRenamed("file_path", "case_name")
    cases = f.select("case_name").distinct().select("case_name", F.array(F.lit("SAST.*")).alias("scope"), F.lit(0).alias("line_tolerance"))
    barred = f.filter("line_number % 4 = 1").select("case_name", F.lit("DOCS.DEAD_REFERENCE").alias("rule_id"), "line_number").distinct()
    want = f.filter("event_id % 3 <> 0").withColumns({"ordinal": F.col("event_id").cast("int"), "severity": F.lit(None).cast("string")})
    return evaluation.grade(want, f.filter("event_id % 3 <> 1"), barred, cases)


@registered(f"WITH {GRADE_ZERO_SQL} SELECT rule_id, sum(matched)::BIGINT AS matched, sum(missed)::BIGINT AS missed, sum(forbidden)::BIGINT AS forbidden, sum(spurious)::BIGINT AS spurious, sum(extra - forbidden - spurious)::BIGINT AS ungraded FROM v GROUP BY rule_id")
def grade_verdicts(spark, sf_dir):
    """The general grading at tolerance 0, where any severity will do; the tests grade with tolerances and severities."""
    g = _graded(spark, sf_dir)
    return g.groupBy("rule_id").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("matched", "missed", "forbidden", "spurious", "ungraded")])


@registered(f"WITH {GRADE_ZERO_SQL} SELECT rule_id, sum(matched)::BIGINT AS tp, sum(forbidden + spurious)::BIGINT AS fp, sum(missed)::BIGINT AS fn FROM v GROUP BY rule_id")
def rule_matrices(spark, sf_dir):
    return evaluation.by_rule(_graded(spark, sf_dir))


@registered(f"WITH {CONFUSION_SQL}, s AS (SELECT lang AS measure, tp + fp AS total, {_wilson_sql('tp', '(tp + fp)', 'lower')} AS lower FROM m), f AS (SELECT lang AS measure, 0.1::DOUBLE AS floor FROM m UNION ALL SELECT 'none', 0.0::DOUBLE) SELECT measure, floor FROM f LEFT JOIN s USING (measure) WHERE coalesce(total, 0) = 0 OR lower < floor - 1e-9")
def floor_shortfalls(spark, sf_dir):
    s = evaluation.scored(_judged(spark, sf_dir)).select(F.col("lang").alias("measure"), F.col("p.lower").alias("lower"), F.col("p.total").alias("total"))
    floors = s.select("measure", F.lit(0.1).alias("floor")).unionByName(spark.createDataFrame([("none", 0.0)], "measure string, floor double"))
    return evaluation.shortfalls(s, floors).select("measure", "floor")


@registered(f"WITH r AS (SELECT n_nationkey, (n_nationkey % 9) / 8.0 AS rate, n_nationkey AS n FROM nation), h AS (SELECT *, round_even(rate * n, 0)::BIGINT AS hits FROM r) SELECT n_nationkey, round({_wilson_sql('hits', 'n', 'lower')}, 6) AS lower, round({_wilson_sql('hits', 'n', 'upper')}, 6) AS upper FROM h")
def rate_intervals(spark, sf_dir):
    i = stats.rate_interval((F.col("n_nationkey") % 9) / F.lit(8.0), F.col("n_nationkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(i["lower"], 6).alias("lower"), F.round(i["upper"], 6).alias("upper"))


RECIPES = ("SAST.WEAK_CRYPTO", "SAST.INSECURE_DESERIALIZATION", "SAST.HARDCODED_SECRET", "SAST.INSECURE_RANDOM", "SAST.INSECURE_HTTP", "QUALITY.ERROR_HANDLING")


@registered(f"WITH {FOUND_SQL} SELECT rule_id, CASE WHEN rule_id IN ({', '.join(map(_q, RECIPES))}) THEN 'recipe' WHEN rule_id LIKE 'SEMANTIC.%' THEN 'declined' ELSE 'unaccounted' END AS state FROM (SELECT DISTINCT rule_id FROM found)")
def recipe_coverage(spark, sf_dir):
    """The rules of all findings in the sources: which of them a recipe mends."""
    one = lambda values: spark.createDataFrame([(v,) for v in values], "rule_id string")
    found, _ = code.analyse_files(source_files(spark, sf_dir).drop("doc_id"), LIMITS)
    return evaluation.recipe_coverage(found.select("rule_id").distinct(), one(fixes.RECIPES), one(["SEMANTIC." + r for r in code.SEMANTIC_RULES]))


@registered(f"WITH {AGREED_SQL} SELECT 'model-1' AS model, count(DISTINCT case_name) AS cases, (SELECT string_agg(chk || '=' || rate, ',' ORDER BY chk) FROM (SELECT chk, round(avg(agrees::INT), 4) AS rate FROM a GROUP BY chk)) AS rates FROM a")
def run_baseline(spark, sf_dir):
    b = evaluation.baseline(_agreed(spark, sf_dir).withColumn("case_name", F.col("case_name").cast("string")), "model-1", "f1", "2024-01-01")
    rates = F.array_join(F.transform(F.array_sort(F.map_entries("rates")), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 4).cast("string"))), ",")
    return b.select("model", F.size("cases").cast("long").alias("cases"), rates.alias("rates"))


@registered("SELECT (count_if(n_nationkey % 7 = 0) = 0) AS ready, (string_agg(n_name, ',' ORDER BY n_name) FILTER (n_nationkey % 7 = 0)) AS failures FROM nation")
def service_readiness(spark, sf_dir):
    """Ready only where all pass; nation 7 and its like fail."""
    checks = table(spark, sf_dir, "nation").select(F.col("n_name").alias("check"), (F.col("n_nationkey") % 7 != 0).alias("passed"))
    return rollup.readiness(checks).withColumn("failures", F.array_join("failures", ","))


# Corpora ----------------------------------------------------------------------------------------------------------------


@registered(f"WITH {SOURCES_SQL} SELECT rule_id, count(*) FILTER (doc_id % 10 <> 0) AS matched, count(*) FILTER (doc_id % 10 = 0) AS mismatched, (SELECT count(*) FROM documents) AS cases FROM parts JOIN given USING (s) WHERE NOT (s = 26 AND line = 1) GROUP BY rule_id")
def evaluated_corpus(spark, sf_dir):
    """Each generated file is a case that expects what its snippets give; every tenth expects another severity."""
    files = source_files(spark, sf_dir)
    known = spark.createDataFrame([(i, r, s, n) for i, x in enumerate(SNIPPETS) for r, s, n in x[1]], "s int, rule_id string, severity string, line int")
    sizes = spark.createDataFrame([(i, x[0].count("\n") + 1) for i, x in enumerate(SNIPPETS)], "s int, lines int")
    key = F.col("doc_id")
    parts = files.select("doc_id", (key % N).alias("s1"), ((key % N + 1 + F.floor(key / N) % (N - 1)) % N).alias("s2"))
    first = parts.select("doc_id", F.col("s1").alias("s"), F.lit(0).alias("before"))
    second = parts.join(F.broadcast(sizes), F.col("s1") == F.col("s")).select("doc_id", F.col("s2").alias("s"), F.col("lines").alias("before"))
    name = F.col("doc_id").cast("string").alias("case_name")
    wants = first.unionByName(second).join(F.broadcast(known), "s").filter("not (s = 26 and line = 1)")
    expected = wants.select(name, (F.col("before") + F.col("line")).alias("line_number"), "rule_id", F.when(key % 10 == 0, "info").otherwise(F.col("severity")).alias("severity")).withColumn("ordinal", F.col("line_number"))
    cases = files.select(name, "file_path", "content", F.lit("").alias("diff"), F.array(F.lit("*")).alias("scope"), F.lit(0).alias("line_tolerance"))
    none = spark.createDataFrame([], "case_name string, rule_id string, line_number int")
    graded, errors = evaluation.evaluate(cases, expected, none, LIMITS)
    n = cases.count() - errors.count()
    return graded.groupBy("rule_id").agg(F.count_if(F.col("verdict") == "matched").alias("matched"), F.count_if(F.col("verdict") == "mismatched").alias("mismatched")).withColumn("cases", F.lit(n).cast("long"))


@registered(f"SELECT rule_id, count(*) AS matched FROM documents JOIN (VALUES {_rows([(i, d[0]) for i, s in enumerate(SCOPES) for d in s[3]])}) d(k, rule_id) ON k = doc_id % {len(SCOPES)} GROUP BY rule_id")
def evaluated_documents(spark, sf_dir):
    diffs = _diffs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("case_name"), F.lit("app.py").alias("path"), "diff", "doc_id")
    claims = documentation.claims(spread(diffs).select("case_name", F.lit(DOC).alias("t")), "case_name", "t").withColumnRenamed("path", "case_name").withColumn("path", F.lit("README.md"))
    index = diffs.select("case_name").join(F.broadcast(spark.createDataFrame(INDEX, "kind string, name string, params array<string>")))
    known = spark.createDataFrame([(i, *d) for i, s in enumerate(SCOPES) for d in s[3]], "k int, rule_id string, subject string, line_number int")
    expected = diffs.join(F.broadcast(known), F.col("doc_id") % len(SCOPES) == F.col("k")).select("case_name", "rule_id", "line_number", F.col("line_number").alias("ordinal"), F.lit("low").alias("severity"))
    cases = diffs.select("case_name", F.array(F.lit("DOCS.*")).alias("scope"), F.lit(0).alias("line_tolerance"))
    none = spark.createDataFrame([], "case_name string, rule_id string, line_number int")
    graded = evaluation.evaluate_documentation(cases, claims, index, diffs.select("case_name", "path", "diff"), expected, none)
    return graded.groupBy("rule_id").agg(F.count_if(F.col("verdict") == "matched").alias("matched"))


# Retrieval --------------------------------------------------------------------------------------------------------------


@registered("SELECT a.vec_id, CASE WHEN a.vec_id % 7 <> 0 THEN round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) END AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf_dir):
    e = retrieval.same_width(table(spark, sf_dir, "embeddings"), "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    a = F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).otherwise(F.slice("embedding", 1, 3))
    return e.join(other, "vec_id").select("vec_id", F.round(retrieval.cosine(a, F.col("b")), 6).alias("score"))


@registered(f"WITH r AS (SELECT n_nationkey AS query, n_nationkey % 5 + 1 AS place FROM nation), c AS (SELECT count(*) AS cases, count_if(place <= 3) AS found, count_if(place = 1) AS first FROM r WHERE query <> 24) SELECT cases, found, first, 1::BIGINT AS broken, round({_wilson_sql('found', 'cases', 'lower')}, 6) AS lower, round({_wilson_sql('first', 'cases', 'lower')}, 6) AS first_lower FROM c")
def recall_share(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query"), (F.col("n_nationkey") % 5 + 1).alias("place"))
    results = n.filter("query <> 24").withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("key", F.col("query") * 10 + F.col("place"))
    expected = n.select("query", (F.col("query") * 10 + F.col("place")).alias("key"))
    s = retrieval.recall_share(retrieval.recall(expected, results, 3))
    return s.select("cases", "found", "first", "broken", F.round("recall.lower", 6).alias("lower"), F.round("first_place.lower", 6).alias("first_lower"))


DRIFT_SQL = """m AS (SELECT 'c' || (o_custkey % 40) AS changed_path, 'd' || (o_orderkey % 50) AS path, (o_orderkey % 20)::INT AS line, max((o_orderkey % 997) / 50000.0::DOUBLE) AS score FROM orders GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY changed_path ORDER BY score DESC, path, line) AS place FROM m), t AS (SELECT * FROM b WHERE place <= 3),
f AS (SELECT * FROM t WHERE score >= 0.0195 AND path NOT IN ('d1', 'd2')), o AS (SELECT path, line, min((changed_path, place)) AS first, arg_min(score, (changed_path, place)) AS score FROM f GROUP BY ALL),
k AS (SELECT *, row_number() OVER (ORDER BY first, path, line) AS n FROM o)"""


@registered(f"WITH {DRIFT_SQL} SELECT path, line, score, (SELECT count(*) FROM t WHERE score < 0.0195) AS below, (SELECT greatest(0, count(*) - 8) FROM o) AS dropped FROM k WHERE n <= 8")
def drift_candidates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = o.groupBy(F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")).alias("changed_path"), F.concat(F.lit("d"), (F.col("o_orderkey") % 50).cast("string")).alias("path"), (F.col("o_orderkey") % 20).cast("int").alias("line")).agg(F.max((F.col("o_orderkey") % 997) / 50000.0).alias("score"))
    found, counts = retrieval.drift_candidates(m, spark.createDataFrame([("d1",), ("d2",)], "path string"), floor=0.0195)
    return found.join(counts).select("path", "line", "score", "below", "dropped")


# Joins, graphs and traces -----------------------------------------------------------------------------------------------


@registered(f"WITH {FINDINGS_SQL} SELECT event_id FROM findings WHERE split_part(rule_id, '.', 1) IN ('SAST', 'QUALITY')")
def deterministic_findings(spark, sf_dir):
    known = spark.createDataFrame([("SAST", "sast"), ("QUALITY", "quality")], "namespace string, producer string")
    return joins.deterministic_only(joins.attribute(findings(spark, sf_dir), known)).select("event_id")


@registered("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def first_symbols(spark, sf_dir):
    return joins.first_symbols(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


CALLS_SQL = "e AS (SELECT DISTINCT 's' || a.l_suppkey AS caller, 's' || b.l_suppkey AS callee FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"


@registered(f"""WITH {CALLS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY callee) AS n FROM e), i AS (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY caller) AS n FROM e),
l0 AS (SELECT unnest(['s1', 's2', 's9']) AS entry), f0 AS (SELECT entry, entry AS name FROM l0),
f1 AS (SELECT DISTINCT entry, callee AS name FROM f0 JOIN o ON caller = name AND n <= 5 WHERE callee <> entry), f2 AS (SELECT DISTINCT entry, callee AS name FROM f1 JOIN o ON caller = name AND n <= 5 EXCEPT SELECT * FROM f0 EXCEPT SELECT * FROM f1),
a AS (SELECT *, 0 AS level FROM f0 UNION ALL SELECT *, 1 FROM f1 UNION ALL SELECT *, 2 FROM f2)
SELECT entry, name, level, coalesce((SELECT string_agg(caller, ',' ORDER BY caller) FROM i WHERE callee = name AND n <= 10), '') AS callers, coalesce((SELECT string_agg(callee, ',' ORDER BY callee) FROM o WHERE caller = name AND n <= 10), '') AS callees FROM a""")
def call_graph(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("caller"))
    nxt = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("caller").alias("callee"))
    graph = joins.call_graph(li.join(nxt, ["l_orderkey", "l_linenumber"]).select("caller", "callee"), spark.createDataFrame([("s1",), ("s2",), ("s9",)], "name string"))
    return graph.select("entry", "name", "level", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


@registered("WITH RECURSIVE " + SPANS_SQL + """, w AS (SELECT trace_id, span_id, 0 AS depth, [lpad(started_ms::VARCHAR, 20, '0') || ':' || span_id] AS path FROM tree WHERE parent IS NULL UNION ALL
  SELECT t.trace_id, t.span_id, w.depth + 1, list_append(w.path, lpad(t.started_ms::VARCHAR, 20, '0') || ':' || t.span_id) FROM w JOIN tree t ON t.trace_id = w.trace_id AND t.parent = w.span_id WHERE w.depth < 4),
r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY path)::INT AS n FROM w), s AS (SELECT trace_id, count(*) AS spans FROM tree GROUP BY trace_id), k AS (SELECT *, count(*) OVER (PARTITION BY trace_id) AS shown FROM r WHERE n <= 6)
SELECT k.trace_id, n, depth, span_id, spans - shown AS omitted FROM k JOIN s ON s.trace_id = k.trace_id""")
def bounded_traces(spark, sf_dir):
    return trace.bounded_tree(trace.resolved(spans(spark, sf_dir)), max_nodes=6)


@registered("SELECT user_id AS trace_id, user_id::VARCHAR AS told, count(*)::INT AS spans FROM events GROUP BY user_id")
def trace_documents(spark, sf_dir):
    made = stores.trace_json(trace.self_time(trace.resolved(spans(spark, sf_dir))))
    return made.select("trace_id", F.get_json_object("value", "$.trace_id").alias("told"), F.json_array_length(F.get_json_object("value", "$.spans")).alias("spans"))


# Chains -----------------------------------------------------------------------------------------------------------------

_KEYS = {"k1": b"one", "k2": b"two"}


@registered("SELECT user_id, count(*) AS n, CASE user_id % 4 WHEN 0 THEN 'intact' WHEN 2 THEN 'tampered' ELSE 'unverifiable' END AS status, CASE WHEN user_id % 4 = 2 THEN 1 END AS broken_at, CASE WHEN user_id % 4 = 2 THEN 'signature' END AS reason, CASE WHEN user_id % 4 = 1 THEN 'k9' ELSE '' END AS unheld FROM events GROUP BY user_id")
def chain_signatures(spark, sf_dir):
    """Signed chains are intact; one with another's signature is tampered; of an unknown key, or unsigned, unverifiable."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.to_json(F.struct("event_id")).alias("payload"))
    s = chain.seal(spread(e), "user_id", "event_id", "payload", signer=("k1", _KEYS["k1"]))
    user = F.col("user_id") % 4
    s = s.withColumns({"key_id": F.when(user == 1, "k9").when(user == 2, "k2").when(user == 3, "").otherwise(F.col("key_id")), "signature": F.when(user == 3, "").otherwise(F.col("signature"))})
    return chain.verify(s, "user_id", "event_id", keys=_KEYS).select("user_id", "n", "status", "broken_at", "reason", F.array_join("unheld", ",").alias("unheld"))


@registered("SELECT user_id, count(*) AS kept, CASE WHEN user_id % 3 <> 0 THEN count_if(ts < TIMESTAMP '2024-01-05') ELSE 0 END AS changed, CASE WHEN user_id % 3 = 0 THEN 'record 1: digest' END AS refused, user_id % 3 <> 0 AS intact FROM events GROUP BY user_id")
def rewritten_stores(spark, sf_dir):
    """Erasure by age: chains with an edited record are left as they are; the others are sealed again, and hold."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.to_json(F.struct("event_id", stamp.alias("recorded_at"))).alias("payload"))
    s = chain.seal(spread(e), "user_id", "event_id", "payload")
    s = s.withColumn("payload", F.when((F.col("user_id") % 3 == 0) & (F.col("sequence") == 1), "{}").otherwise(F.col("payload")))
    older = chain.is_older(F.get_json_object("payload", "$.recorded_at"), F.lit("2024-01-05").cast("timestamp"))
    fresh, outcome = chain.rewrite(s, "user_id", "event_id", lambda d: chain.erase(d, older, "p1", "2024-06-01"))
    state = chain.verify(fresh, "user_id", "event_id").select("user_id", (F.col("status") == "intact").alias("intact"))
    return outcome.join(state, "user_id")


@registered("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '{\"event\":' || event_id || ',\"project\":\"\",\"redacted_at\":\"t\",\"redaction_policy\":\"p\"}' ELSE '{\"event\":' || event_id || ',\"project\":\"x\"}' END AS payload FROM events")
def redacted_records(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_json(F.struct(F.col("event_id").alias("event"), F.lit("x").alias("project"))).alias("payload"))
    return chain.redact(e, F.col("user_id") % 2 == 0, "p", "t").select("event_id", "payload")


@registered(f"WITH {FINDINGS_SQL} SELECT file_path AS run, count_if(line_number % 4 <> 0)::INT AS n_findings, count_if(line_number % 4 = 0)::INT AS n_suppressed, CASE WHEN count_if(severity = 'critical' AND line_number % 4 <> 0) > 0 THEN 'fail' ELSE 'warn' END AS verdict, count_if(severity = 'critical' AND line_number % 4 <> 0) > 0 AS completed FROM findings GROUP BY file_path")
def decision_records(spark, sf_dir):
    f = findings(spark, sf_dir)
    told = f.select(F.col("file_path").alias("run"), "rule_id", "file_path", "line_number", F.lit("sast").alias("producer"), (F.col("severity") == "critical").alias("blocks"), F.when(F.col("line_number") % 4 == 0, F.col("rule_id")).alias("directive"), F.lit(None).cast("string").alias("reason"))
    runs = f.select(F.col("file_path").alias("run")).distinct().select("run", F.lit("fail").alias("verdict"), F.lit(1).alias("exit_code"), F.lit("p").alias("project"), F.lit("7").alias("merge_request"), F.lit("t").alias("trace_id"), F.lit("2024-01-01").alias("recorded_at"))
    made, at = chain.decisions(runs, told), lambda p: F.get_json_object("payload", p)
    return made.select("run", F.json_array_length(at("$.findings")).alias("n_findings"), F.json_array_length(at("$.suppressions")).alias("n_suppressed"), at("$.verdict").alias("verdict"), (at("$.completed") == "true").alias("completed"))


# Stores -----------------------------------------------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    import uuid

    from tessera.session import shared_folder

    folder = f"{shared_folder(spark).rstrip('/')}/tessera-stores/{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{folder}/{name}"


@registered(f"WITH {FINDINGS_SQL} SELECT file_path, count(*) AS rules, sum(n)::BIGINT AS occurrences FROM (SELECT file_path, rule_id, count(*) AS n FROM findings GROUP BY ALL) GROUP BY file_path")
def history_store(spark, sf_dir):
    """The history written as versioned documents, and read again."""
    from tessera.plans.fixtures import sightings

    path = _folder(spark, "history")
    stores.write_history(history.consolidate(sightings(spark, sf_dir)), path)
    return stores.read_history(spark, path).groupBy("file_path").agg(F.count("*").alias("rules"), F.sum("occurrences").alias("occurrences"))


@registered("""SELECT 'c' || doc_id AS name, 'src/' || source || '/m' || doc_id || '.py' AS file, md5(coalesce(text, '')) AS digest, (doc_id % 3)::INT AS line_tolerance, (doc_id % 4)::INT AS expected,
  CASE WHEN doc_id % 4 > 0 THEN (doc_id % 90 * (doc_id % 4) + (doc_id % 4) * (doc_id % 4 - 1) // 2)::BIGINT END AS lines, CASE WHEN doc_id % 4 > 1 THEN 'high' END AS severity, doc_id % 2 = 0 AS barred FROM documents""")
def corpus_cases(spark, sf_dir):
    """Every document as a YAML case of an evaluation corpus, written as a file and read again."""
    d, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    number = lambda c: c.cast("string")
    wants = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i < key % 4, F.concat(F.lit("  - {rule: R"), number(i), F.lit(", line: "), number(key % 90 + i), F.when(i == 1, ", severity: high}").otherwise("}"))))
    expect = F.when(key % 4 > 0, F.concat(F.lit("expect:\n"), F.array_join(wants, "\n"))).otherwise("expect: []")
    head = F.concat(F.lit("name: c"), number(key), F.lit("\nfile: 'src/"), "source", F.lit("/m"), number(key), F.lit(".py'\nscope: [\"SAST.*\"]\nline_tolerance: "), number(key % 3), F.lit("\ndiff: '"), F.hex(F.coalesce("text", F.lit("")).cast("binary")), F.lit("'"))
    text = F.concat_ws("\n", head, expect, F.when(key % 2 == 0, "expect_absent:\n- rule: X\n  line: 0"))
    root = _folder(spark, "corpus")
    checkout.write_tree(d.select(F.concat("source", F.lit("/c"), number(key), F.lit(".yaml")).alias("path"), text.cast("binary").alias("content")), root)
    cases = stores.read_corpus(spark, root, stores.CORPORA["cases"])
    lines = F.when(F.size("expect") > 0, F.aggregate("expect", F.lit(0).cast("long"), lambda s, e: s + e["line"]))
    return cases.select("name", "file", F.md5(F.unhex("diff")).alias("digest"), "line_tolerance", F.size("expect").alias("expected"), lines.alias("lines"), F.get("expect", F.lit(1))["severity"].alias("severity"), F.col("expect_absent").isNotNull().alias("barred"))


@registered("SELECT user_id, count(*) AS n, 'intact' AS status FROM events GROUP BY user_id")
def sealed_store(spark, sf_dir):
    """Two appends to one store of sealed records, then verified as a whole."""
    e, path = table(spark, sf_dir, "events").select("user_id", "event_id", F.to_json(F.struct("event_id", "event_type")).alias("payload")), _folder(spark, "records")
    middle = e.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    for half in (e.filter(F.col("event_id") <= middle), e.filter(F.col("event_id") > middle)):
        sealed.append(half, path, "user_id", "event_id")
    return chain.verify(sealed.read(spark, path), "user_id", "event_id").select("user_id", "n", "status")


@registered("SELECT user_id, count(*) AS n, count(DISTINCT event_id) AS events, 'intact' AS status FROM events GROUP BY user_id")
def contested_store(spark, sf_dir):
    """Two writers begin at one version: the second is refused, and appends again; a batch that is replayed changes nothing."""
    e, path = table(spark, sf_dir, "events").select("user_id", "event_id", F.to_json(F.struct("event_id", "event_type")).alias("payload")), _folder(spark, "contested")
    third = lambda i: e.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i)
    sealed.append(third(0), path, "user_id", "event_id", expected=0)
    try:
        sealed.append(third(1), path, "user_id", "event_id", expected=0)
        raise AssertionError("a fork was not refused")
    except sealed.Conflict:
        sealed.append(third(1), path, "user_id", "event_id", expected=1)
    for _ in range(2):
        sealed.batches("s", path, "user_id", "event_id")(third(2), 7)
    records = sealed.read(spark, path)
    state = chain.verify(records, "user_id", "sequence").select("user_id", "n", "status")
    return state.join(records.groupBy("user_id").agg(F.countDistinct("event_id").alias("events")), "user_id")


@registered(f"WITH {METRICS_SQL} SELECT project_id, count(*) AS files FROM f GROUP BY project_id")
def metrics_store(spark, sf_dir):
    path = _folder(spark, "metrics")
    stores.write_metrics(_file_metrics(spark, sf_dir), path)
    return spark.read.json(path).groupBy("project_id").agg(F.count("*").alias("files"))


@registered("SELECT user_id AS project_id, event_id AS mr_id, CASE event_id % 3 WHEN 0 THEN 'open' ELSE 'update' END AS action FROM events WHERE event_type = 'click' AND event_id % 3 <> 2")
def merge_events(spark, sf_dir):
    e, key = table(spark, sf_dir, "events"), F.col("event_id")
    action = F.when(key % 3 == 0, "open").when(key % 3 == 1, "update").otherwise("close")
    kind = F.when(F.col("event_type") == "click", "merge_request").otherwise("push")
    raw = e.select(F.to_json(F.struct(kind.alias("object_kind"), F.struct(F.col("user_id").alias("id")).alias("project"), F.struct(key.alias("iid"), action.alias("action")).alias("object_attributes"))).alias("body"))
    return stores.merge_request_events(raw)


# Routing and memory -----------------------------------------------------------------------------------------------------


@registered("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'already_run' END END AS refused FROM orders")
def accepted_handoffs(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    asked = o.select("o_orderkey", key.cast("string").alias("file_path"), F.when(key % 3 == 0, "poetry").when(key % 3 == 1, "security").otherwise("performance").alias("to"))
    ran = asked.filter("o_orderkey % 2 = 0").select("file_path", F.lit("security").alias("to"))
    return routing.accept_handoffs(asked, ran, 0).select("o_orderkey", "refused")


@registered("SELECT n_regionkey::VARCHAR AS file_path, '## Architecture' || chr(10) || chr(10) || 'a' || n_regionkey || chr(10) || chr(10) || '## Security' || chr(10) || chr(10) || 's' || n_regionkey AS text FROM (SELECT DISTINCT n_regionkey FROM nation)")
def composed_reports(spark, sf_dir):
    r = table(spark, sf_dir, "nation").select("n_regionkey").distinct()
    part = lambda agent, letter: r.select(F.col("n_regionkey").cast("string").alias("file_path"), F.lit(agent).alias("agent"), F.concat(F.lit(letter), F.col("n_regionkey").cast("string")).alias("body"))
    return routing.compose(part("security", "s").unionByName(part("architecture", "a")).unionByName(r.select(F.col("n_regionkey").cast("string").alias("file_path"), F.lit("performance").alias("agent"), F.lit("  ").alias("body"))))


@registered("WITH n AS (SELECT o_custkey AS key, min(o_orderdate) AS submitted FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1), q AS (SELECT 500 - count(*) AS room FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 50 = 0)), r AS (SELECT *, row_number() OVER (ORDER BY submitted, key) AS n FROM n) SELECT key FROM r, q WHERE n <= greatest(0, room)")
def submitted_jobs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    jobs = o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"), F.when(F.col("o_custkey") % 50 == 0, "queued").otherwise("running").alias("state"))
    return routing.submit(jobs, o.select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("submitted")), 500).select("key")


@registered("SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def claimed_job(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("submitted"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("running").alias("state"))
    return routing.claim_next(o).select("key")


STATES = ("queued", "running", "succeeded", "failed")


@registered(f"WITH m AS (SELECT event_id, list_extract({list(STATES)}, (event_id % 4 + 1)::INT) AS before, list_extract({list(STATES)}, (event_id // 4 % 4 + 1)::INT) AS after FROM events) SELECT event_id FROM m WHERE before || '>' || after NOT IN ('queued>running', 'running>succeeded', 'running>failed', 'queued>failed')")
def illegal_moves(spark, sf_dir):
    state = lambda at: F.element_at(F.array(*[F.lit(s) for s in STATES]), (at % 4 + 1).cast("int"))
    moves = table(spark, sf_dir, "events").select("event_id", state(F.col("event_id")).alias("before"), state(F.floor(F.col("event_id") / 4)).alias("after"))
    return routing.illegal_transitions(moves).select("event_id")


@registered(f"""WITH {FINDINGS_SQL}, {MEMORY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY seen, content) AS n FROM memory), p AS (SELECT bucket, string_agg('- ' || content, chr(10) ORDER BY n) AS t FROM r WHERE bucket = 'critical' OR (bucket = 'high' AND n <= 20) OR (bucket = 'normal' AND n <= 15) GROUP BY bucket)
SELECT md5('## CRITICAL' || chr(10) || (SELECT t FROM p WHERE bucket = 'critical') || chr(10) || chr(10) || '## HIGH' || chr(10) || (SELECT t FROM p WHERE bucket = 'high') || chr(10) || chr(10) || '## AFFECTED CODE' || chr(10) || '- `a.py:f` - renamed' || chr(10) || chr(10) || '## NORMAL' || chr(10) || (SELECT t FROM p WHERE bucket = 'normal') || chr(10) || chr(10) || '## SUMMARY' || chr(10) || 'old') AS context""")
def memory_context(spark, sf_dir):
    affected = spark.createDataFrame([("a.py", "f", "renamed", 1)], "path string, symbol string, reason string, at long")
    return routing.load_context(memory(spark, sf_dir), affected, "old").select(F.md5(F.col("context").cast("binary")).alias("context"))


# Edits ------------------------------------------------------------------------------------------------------------------

#: Line, rule, line after its recipe (null: declined or unchanged).
EDITS = (
    ("h = hashlib.md5(x) + hashlib.sha1(y)", "SAST.WEAK_CRYPTO", "h = hashlib.sha256(x) + hashlib.sha256(y)"),
    ("c = yaml.load(t)", "SAST.INSECURE_DESERIALIZATION", "c = yaml.safe_load(t)"),
    ("c = yaml.load(t, Loader=L)", "SAST.INSECURE_DESERIALIZATION", None),
    ("API_KEY = 'abc123'", "SAST.HARDCODED_SECRET", 'API_KEY = os.environ["API_KEY"]'),
    ("y = random.choice(z) + random.random()", "SAST.INSECURE_RANDOM", "y = secrets.SystemRandom().choice(z) + random.random()"),
    ("y = 1  # random.choice(z)", "SAST.INSECURE_RANDOM", None),
    ('u = "http://a.b/c"', "SAST.INSECURE_HTTP", 'u = "https://a.b/c"'),
    ('u = "http://localhost:8080/"', "SAST.INSECURE_HTTP", None),
    ("except:", "QUALITY.ERROR_HANDLING", "except Exception:"),
    ("z = 1", "SAST.WEAK_CRYPTO", None),
)


def _edited(spark, sf_dir):
    d, key = table(spark, sf_dir, "documents").select("doc_id"), (F.col("doc_id") % len(EDITS) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(e[i]) for e in EDITS]), key)
    files = d.select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"), F.concat(F.lit("import os\n"), pick(0), F.lit("\nlast = 1\n")).alias("content"), pick(1).alias("rule_id"))
    found = files.select("file_path", F.lit(2).alias("line_number"), "rule_id").unionByName(files.select("file_path", F.lit(1).alias("line_number"), F.lit("AGENT.GUESS").alias("rule_id")))
    return files, found


@registered(f"SELECT doc_id, before, after FROM documents JOIN (VALUES {_rows([(i, e[0], e[2]) for i, e in enumerate(EDITS)])}) e(k, before, after) ON k = doc_id % {len(EDITS)} WHERE after IS NOT NULL AND doc_id % 3 <> 0")
def fix_suggestions(spark, sf_dir):
    """Suggestions on changed lines; every third file's change did not touch the line."""
    files, found = _edited(spark, sf_dir)
    changed = files.select("file_path", F.when(F.col("doc_id") % 3 != 0, 2).otherwise(9).alias("line"))
    got = fixes.suggest(found, files.select("file_path", "content"), changed)
    return got.select(F.regexp_extract("file_path", "([0-9]+)", 1).cast("long").alias("doc_id"), "before", "after")


@registered(f"SELECT doc_id, 'import os' || chr(10) || coalesce(after, before) || chr(10) || 'last = 1' || chr(10) AS content FROM documents JOIN (VALUES {_rows([(i, e[0], e[2]) for i, e in enumerate(EDITS)])}) e(k, before, after) ON k = doc_id % {len(EDITS)} WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 7 = 0")
def applied_fixes(spark, sf_dir):
    """Files after their edits; every seventh has one that is out of range, so none of its edits holds."""
    files, found = _edited(spark, sf_dir)
    edits = fixes.suggest(found, files.select("file_path", "content")).select("file_path", "line", "after").unionByName(files.filter("doc_id % 7 = 0").select("file_path", F.lit(99).alias("line"), F.lit("x").alias("after")))
    return fixes.applied(files.select("file_path", "content"), edits).select(F.regexp_extract("file_path", "([0-9]+)", 1).cast("long").alias("doc_id"), "content")


IMPORTS = (("import os\nimport sys\n\nx = 1\n", 2), ('"""Doc.\n\nMore."""\nx = 1\n', 3), ("x = 1\n", 0), ("import secrets\nx = 1\n", None), ("def (\n", None), ("", None), ("import os.path as p\nfrom a import (\n    b,\n)\nx = 1\n", 4), ("def f():\n    import secrets\n", None))


@registered(f"SELECT doc_id, anchor FROM documents JOIN (VALUES {_rows([(i, a) for i, (_, a) in enumerate(IMPORTS)])}) e(k, anchor) ON k = doc_id % {len(IMPORTS)}")
def import_anchors(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*[F.lit(t) for t, _ in IMPORTS]), (F.col("doc_id") % len(IMPORTS) + 1).cast("int")).alias("content"))
    return d.select("doc_id", fixes.import_anchor(F.col("content"), "secrets").alias("anchor"))


# Roll-ups and reports ---------------------------------------------------------------------------------------------------


@registered("SELECT o_custkey, CASE WHEN count_if(o_orderstatus = 'F') > 1 AND (count(*) > 5) THEN 1 WHEN count_if(o_orderstatus = 'P') > 0 THEN 1 ELSE 0 END AS code FROM orders GROUP BY o_custkey")
def exit_codes(spark, sf_dir):
    s = F.col("o_orderstatus")
    runs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(s == "F").alias("blocking"), F.count("*").alias("n"), F.count_if(s == "P").alias("unanalysed"), F.count_if(s == "O").alias("failed"))
    result = F.when((F.col("blocking") > 1) & (F.col("n") > 5), "fail").otherwise("warn")
    return runs.select("o_custkey", rollup.exit_code(result, F.col("unanalysed"), F.col("failed"), F.col("blocking")).alias("code"))


@registered(f"WITH {FINDINGS_SQL} SELECT rule_id, severity, count(*) AS n FROM findings GROUP BY ALL")
def severity_maps(spark, sf_dir):
    per_file = findings(spark, sf_dir).groupBy("rule_id", "file_path", "severity").agg(F.count("*").alias("n")).groupBy("rule_id", "file_path").agg(F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("by_severity"))
    return rollup.map_totals(per_file, "by_severity", "rule_id").select("rule_id", F.explode("by_severity").alias("severity", "n"))


@registered("""SELECT lang, source, doc_id // 64 AS block, md5(string_agg('### ' || doc_id || ':1-' || len(string_split(text, chr(10))) || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id)) AS digest
FROM documents WHERE text IS NOT NULL GROUP BY ALL""")
def evidence_texts(spark, sf_dir):
    """Every document as one chunk; a text of evidence for each language and source of 64 ids."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    cited = d.select("lang", "source", F.floor(F.col("doc_id") / 64).alias("block"), "doc_id", F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), "text")
    found = reports.evidence(cited, ["lang", "source", "block"], ["doc_id"])
    return found.select("lang", "source", "block", F.md5(F.col("text").cast("binary")).alias("digest"))


@registered(f"""WITH {FINDINGS_SQL}, c AS (SELECT split_part(rule_id, '.', 1) AS ns, count(*) AS n FROM findings GROUP BY 1), k(control, ns) AS (VALUES ('AC-1', 'SAST'), ('AC-1', 'SECRETS'), ('QA-2', 'QUALITY'), ('QA-2', 'PERFORMANCE'), ('DR-3', 'RESILIENCE')), t AS (SELECT control, coalesce(sum(n), 0) AS n FROM k LEFT JOIN c USING (ns) GROUP BY control)
SELECT '# Control coverage' || chr(10) || chr(10) || 'Own, version 1, by us (x).' || chr(10) || chr(10) || 'These are findings that concern a control; whether it is met is not said here.' || chr(10) || chr(10) || '## With findings' || chr(10) || chr(10) || '| control | findings | about |' || chr(10) || '|---|---:|---|' || chr(10) || (SELECT string_agg('| `' || control || '` | ' || n::BIGINT || ' | about ' || control || ' |', chr(10) ORDER BY control) FROM t WHERE n > 0)
|| chr(10) || chr(10) || '## Without findings' || chr(10) || chr(10) || (SELECT string_agg('- `' || control || '`: about ' || control, chr(10) ORDER BY control) FROM t WHERE n = 0) || chr(10) || chr(10) || '## In no control' || chr(10) || chr(10) || (SELECT string_agg('- `' || ns || '`', chr(10) ORDER BY ns) FROM c WHERE ns NOT IN (SELECT ns FROM k)) AS text""")
def control_report(spark, sf_dir):
    covered, unmapped = joins.control_coverage(spark.createDataFrame(list(CONTROLS), "control string, namespaces array<string>"), findings(spark, sf_dir))
    return reports.coverage_report({"name": "Own", "version": "1", "publisher": "us", "reference": "x"}, covered.withColumn("description", F.concat(F.lit("about "), "control")), unmapped)


@registered("""WITH r AS (SELECT lang AS chk, avg(toxic) FILTER (WHERE doc_id % 2 = 0) AS b, avg(toxic) FILTER (WHERE doc_id % 2 = 1) AS a FROM labels JOIN documents USING (doc_id) GROUP BY lang
  UNION ALL SELECT 'source ' || source, avg(toxic) FILTER (WHERE doc_id % 2 = 0), NULL FROM labels JOIN documents USING (doc_id) GROUP BY source UNION ALL SELECT 'all', NULL, avg(toxic) FROM labels UNION ALL SELECT 'same', 0.3, 0.3),
l AS (SELECT chk, CASE WHEN b IS NULL THEN 3 WHEN a IS NULL THEN 4 WHEN a - b > 1e-9 THEN 0 WHEN a - b < -1e-9 THEN 1 ELSE 2 END AS k, '- `' || chk || '`' || CASE WHEN a IS NULL OR b IS NULL THEN '' ELSE printf(': %.2f to %.2f (%+.2f)', b, a, a - b) END AS t FROM r WHERE a IS NOT NULL OR b IS NOT NULL),
parts AS (SELECT k, string_agg(t, chr(10) ORDER BY chk) AS t FROM l GROUP BY k)
SELECT '# Against the baseline' || chr(10) || chr(10) || 'The prompt changed. The model is the same.' || (SELECT string_agg(chr(10) || chr(10) || '## ' || ['Rose', 'Fell', 'Unchanged', 'Not in the baseline', 'No longer measured'][k + 1] || chr(10) || chr(10) || t, '' ORDER BY k) FROM parts) AS text""")
def comparison_report(spark, sf_dir):
    """Toxic shares of the even documents against those of the odd ones; checks that only one run has are made of sources and of all."""
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    rate = lambda rows, check: rows.groupBy(check.alias("check")).agg(F.avg("toxic").alias("rate"))
    even, odd, same = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1"), spark.createDataFrame([("same", 0.3)], "check string, rate double")
    before = rate(even, F.col("lang")).unionByName(rate(even, F.concat(F.lit("source "), "source"))).unionByName(same)
    after = rate(odd, F.col("lang")).unionByName(rate(table(spark, sf_dir, "labels"), F.lit("all"))).unionByName(same)
    return reports.comparison_report(evaluation.compare(before, after), True, False)


@registered(f"WITH {CONFUSION_SQL}, t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM m) SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / (tp + fp)::DOUBLE, 4) AS precision, round(2.0 * tp / (2 * tp + fp + fn), 4) AS f1, false AS met FROM t")
def score_summary(spark, sf_dir):
    total = evaluation.scored(evaluation.total(_judged(spark, sf_dir)))
    value = reports.evaluation_summary(total, spark.createDataFrame([], "case_name string, reason string"), {"precision": 0.99})
    at = lambda p, kind: F.get_json_object("value", p).cast(kind)
    return value.select(at("$.tp", "long").alias("tp"), at("$.fp", "long").alias("fp"), at("$.precision", "double").alias("precision"), at("$.f1", "double").alias("f1"), at("$.met", "boolean").alias("met"))


@registered("SELECT doc_id, length(text) AS full_length, true AS fits, length(text) > 500 AS was_cut FROM documents")
def cut_texts(spark, sf_dir):
    cut = reports.cut(F.col("text"), 500)
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("full_length"), (F.length(cut) <= 500).alias("fits"), (cut != F.col("text")).alias("was_cut"))


@registered(f"SELECT user_id, CASE WHEN status = 'intact' THEN 'intact: ' || n || ' record(s), 0 signed, up to sequence ' || n ELSE 'TAMPERED at record ' || broken_at || ': ' || reason END AS line FROM ({ORACLES['chain_verify']})")
def chain_lines(spark, sf_dir):
    return reports.chain_line(verified(spark, sf_dir)).select("user_id", "line")


@registered("SELECT item_id AS prompt, chk AS \"check\", CASE WHEN chk = 'cites' AND item_id % 2 = 1 THEN 'only a real one' WHEN chk = 'either' AND item_id % 2 = 1 AND item_id % 3 <> 0 THEN 'only a real one,never guess' ELSE '' END AS missing, CASE WHEN (chk = 'cites' AND item_id % 2 = 1) OR (chk = 'either' AND item_id % 2 = 1 AND item_id % 3 <> 0) THEN 'unbacked' ELSE 'aligned' END AS state FROM benchmark, (SELECT unnest(['cites', 'either']) AS chk)")
def backed_checks(spark, sf_dir):
    key = F.col("item_id")
    prompts = table(spark, sf_dir, "benchmark").select(key.alias("prompt"), F.concat(F.lit("Cite a location. "), F.when(key % 2 == 0, "And ONLY a\nreal one. ").otherwise(""), F.when(key % 3 == 0, "Never   guess.").otherwise("")).alias("text"))
    wanted = spark.createDataFrame([("cites", ["cite a location", "only a real one"], False), ("either", ["only a real one", "never guess"], True)], "check string, phrases array<string>, any_of boolean")
    return evaluation.backed_checks(wanted, prompts).select("prompt", "check", F.array_join("missing", ",").alias("missing"), "state")


def _picks_sql(query: str, limit: int) -> str:
    return f"""WITH RECURSIVE r AS (SELECT {query} AS query, vec_id AS key, (vec_id * 7919 % 1000 + 1) / 1000.0::DOUBLE AS score, embedding::DOUBLE[] AS v FROM embeddings),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS n FROM r) WHERE n <= 40), {_mmr_sql('cut', limit)} SELECT query, key, place FROM picked"""


def _ranked_vectors(spark, sf_dir, query):
    e, key = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    return e.select(query.alias("query"), key.alias("key"), ((key * 7919 % 1000 + 1) / 1000.0).cast("double").alias("score"), F.col("embedding").cast("array<double>").alias("vector"))


@registered(_picks_sql("vec_id % 20", 2))
def diverse_pairs(spark, sf_dir):
    """Two diverse picks of the best candidates of each of twenty lists."""
    return retrieval.mmr(_ranked_vectors(spark, sf_dir, F.col("vec_id") % 20), 2)


@registered(_picks_sql("vec_id // 100", 6))
def diverse_picks(spark, sf_dir):
    """Six diverse picks of the candidates of each hundred vectors."""
    return retrieval.mmr(_ranked_vectors(spark, sf_dir, F.floor(F.col("vec_id") / 100)), 6)


@registered("""SELECT '<!-- review-report -->' || e || '# Review: blocked' || e || '## Blocked by' || e || (SELECT string_agg('- ' || n_name, chr(10) ORDER BY n_name) FROM nation WHERE n_regionkey = 0) || e || '## Not analysed (no finding here means that nothing was examined)' || e
|| (SELECT string_agg('- `' || n_name || '`: why ' || n_nationkey, chr(10) ORDER BY n_name) FROM nation WHERE n_regionkey = 1) || e || '## Suppressed' || e || '- `a.py` line 3: `SAST.XSS`, no reason given' || e || '## Static analysis' || e || '- 2 high' || e
|| 'Policy 1.0, 25 file(s) considered, trace `t1`' || e || '---' || e || (SELECT string_agg(r_name, chr(10) ORDER BY r_regionkey) FROM region) AS text FROM (SELECT chr(10) || chr(10) AS e)""")
def review_comment(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    empty = lambda schema: spark.createDataFrame([], schema)
    found = spark.createDataFrame([("a.py", 4, "SAST.XSS", "high", None, None, None), ("b.py", 4, "SAST.XSS", "high", None, None, None), ("a.py", 3, "SAST.XSS", "low", "SAST.XSS", 3, "")], "file_path string, line_number int, rule_id string, severity string, directive string, directive_line int, directive_reason string")
    unseen = n.filter("n_regionkey = 1").select(F.col("n_name").alias("file_path"), F.concat(F.lit("why "), F.col("n_nationkey").cast("string")).alias("reason"))
    return reports.review_comment(
        n.agg(F.lit("fail").alias("result"), F.count("*").alias("files")), n.filter("n_regionkey = 0").select(F.col("n_name").alias("reason")), unseen, empty("file_path string, reason string"), empty("reason string"), found,
        empty("file_path string, line_number int, rule_id string, seen_before int, first_seen string"), empty("file_path string, line_number int, rule_id string, verified boolean"),
        table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ordinal"), F.col("r_name").alias("text")), "1.0", "t1",
    )
