"""Generated source files with known findings: each document id becomes one file of two snippets and a tail, and a diff.

What each snippet must give was worked out by hand from the rules' meaning, for the limits without a policy. Names differ between
snippets, so that what a file gives is what its parts give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.session import spread, table

#: Text; findings (rule, severity, line); functions (name, line, end, complexity, loops, parameters, recursive); what issues cost in
#: the quality and in the performance score, before they are told apart by place; what testability loses.
SNIPPETS: list[tuple[str, list[tuple[str, str, int]], list[tuple], int, int, int]] = [
    ("import os\n\nTOTAL = 7", [], [], 0, 0, 0),
    ("def run_command(name):\n    os.system('ls ' + name)", [("SAST.COMMAND_INJECTION", "critical", 2)], [("run_command", 1, 2, 1, 0, 1, 0)], 0, 0, 0),
    ("\t# eval(danger) in a comment with a tab\nvalue_one = eval(danger)", [("SAST.COMMAND_INJECTION", "critical", 2)], [], 0, 0, 0),
    ("def find_user(cur, name):\n    sql = 'SELECT * FROM users WHERE name = ' + name\n    cur.execute(sql)", [("SAST.SQL_INJECTION", "critical", 2)], [("find_user", 1, 3, 1, 0, 2, 0)], 0, 0, 0),
    ("def find_safe(cur, name):\n    sql_safe = 'SELECT * FROM users WHERE name = ?'\n    cur.execute(sql_safe, (name,))", [], [("find_safe", 1, 3, 1, 0, 2, 0)], 0, 0, 0),
    ("def find_order(cur, key):\n    text_a = f'delete from orders where id = {key}'\n    text_b = text_a\n    cur.execute(text_b)\n    cur.execute(text_b)", [("SAST.SQL_INJECTION", "critical", 2)], [("find_order", 1, 5, 1, 0, 2, 0)], 0, 0, 0),
    ("def load_all(keys, conn):\n    for key in keys:\n        conn.get(key)\n        plain = {}.get(key)", [("PERFORMANCE.N_PLUS_ONE", "high", 2)], [("load_all", 1, 4, 2, 1, 2, 0)], 0, 10, 0),
    ("def pairs_of(rows):\n    for one in rows:\n        for two in rows:\n            use(one, two)", [("PERFORMANCE.HIGH_COMPLEXITY", "medium", 1)], [("pairs_of", 1, 4, 3, 2, 1, 0)], 0, 5, 0),
    ("def cubes_of(rows):\n    return [1 for x in rows for y in rows for z in [w for w in rows if w]]", [("PERFORMANCE.HIGH_COMPLEXITY", "medium", 1)], [("cubes_of", 1, 2, 6, 2, 1, 0)], 0, 5, 0),
    ("def deep_three(rows):\n    for one in rows:\n        while one:\n            for two in one:\n                use(two)", [("PERFORMANCE.HIGH_COMPLEXITY", "high", 1)], [("deep_three", 1, 5, 4, 3, 1, 0)], 0, 10, 0),
    ("def climb(node):\n    return climb(node.parent) if node else None", [("PERFORMANCE.RECURSIVE_RISK", "medium", 1)], [("climb", 1, 2, 1, 0, 1, 1)], 0, 5, 0),
    ("def read(handle):\n    return handle.read()", [], [("read", 1, 2, 1, 0, 1, 0)], 0, 0, 0),
    ("def joined(rows):\n    text = ''\n    for row in rows:\n        text += f'{row},'\n        count += 1\n    return text", [("PERFORMANCE.INEFFICIENT_LOOP", "low", 4)], [("joined", 1, 6, 2, 1, 1, 0)], 0, 2, 0),
    ("def leaky(path):\n    stream = open(path)\n    return stream.name", [("PERFORMANCE.MEMORY_LEAK", "high", 2)], [("leaky", 1, 3, 1, 0, 1, 0)], 0, 20, 0),
    ("def closed_one(path):\n    source_c = open(path)\n    source_c.close()", [("PERFORMANCE.MEMORY_LEAK", "high", 2)], [("closed_one", 1, 3, 1, 0, 1, 0)], 0, 10, 0),
    ("def with_one(path):\n    with open(path) as held:\n        return held.name", [], [("with_one", 1, 3, 1, 0, 1, 0)], 0, 0, 0),
    ("try:\n    work_one()\nexcept:\n    pass", [("QUALITY.ERROR_HANDLING", "high", 3)], [], 15, 0, 0),
    ("try:\n    work_two()\nexcept Exception:\n    log(1)\nexcept BaseException:\n    log(2)", [("QUALITY.ERROR_HANDLING", "low", 3)], [], 2, 0, 0),
    ("try:\n    lock_it(3)\nexcept ValueError:\n    raise", [("QUALITY.ERROR_HANDLING", "medium", 1)], [], 5, 0, 0),
    ("class Service:\n    def __init__(self, kind):\n        self.engine = Engine(kind)\n        self.names = List(kind)\n        self.other = make.Thing()", [("QUALITY.SOLID_DIP", "low", 3)], [("__init__", 2, 5, 1, 0, 2, 0)], 2, 0, 0),
    ("class Wide:\n" + "\n".join(f"    def do_{i}(self): return {i}" for i in range(11)), [("QUALITY.SOLID_SRP", "medium", 1)], [(f"do_{i}", i + 2, i + 2, 1, 0, 1, 0) for i in range(11)], 5, 0, 0),
    ("class Single:\n    @classmethod\n    def get_instance(cls): return cls", [("QUALITY.TESTABILITY", "low", 1)], [("get_instance", 3, 3, 1, 0, 1, 0)], 2, 0, 5),
    ("def many(a, b, c, d, e, g):\n    global state_x, state_y\n    return a", [("QUALITY.TESTABILITY", "medium", 1)], [("many", 1, 3, 1, 0, 6, 0)], 10, 0, 15),
    ("def branches(v):\n" + "\n".join(f"    if v == {i}: v += {i}" for i in range(8)) + "\n    return v and 1 or 2", [], [("branches", 1, 10, 11, 0, 1, 0)], 0, 0, 0),
    ("import time\ntime.sleep(3)\nrows_big = handle_r.readlines()\nzeros = [0] * 100000", [("PERFORMANCE.BLOCKING_OPERATION", "low", 2), ("PERFORMANCE.LARGE_MEMORY", "medium", 3), ("PERFORMANCE.LARGE_MEMORY", "medium", 4)], [], 0, 12, 0),
    ("k1 = 1\nk2 = 2\nk3 = 3\nk4 = 4\nk5 = 5\n\n# again\nk1 = 1\nk2  =  2\nk3 = 3\n\tk4 = 4\nk5 = 5", [], [], 0, 0, 0),
    ("token_a = hashlib.md5(data_q)  # review-ignore: SAST.WEAK_CRYPTO - a cache key\ntoken_b = hashlib.md5(data_r)", [("SAST.WEAK_CRYPTO", "medium", 1), ("SAST.WEAK_CRYPTO", "medium", 2)], [], 0, 0, 0),
    ("password = 'hunter22'\nDEBUG = True\nurl_h = 'http://example.com/x'", [("SAST.HARDCODED_SECRET", "high", 1), ("SAST.DEBUG_CODE", "medium", 2), ("SAST.INSECURE_HTTP", "low", 3)], [], 0, 0, 0),
]
# The branches: 1 + 8 ifs + 2 for the two boolean operators = 11, which is over 10.
SNIPPETS[23] = (SNIPPETS[23][0], [("QUALITY.MAINTAINABILITY", "high", 1)], SNIPPETS[23][2], 10, 0, 0)
# Indented, the repeated block would not parse: a line of it stands alone behind a conditional.
SNIPPETS[25] = ("k1 = 1\nk2 = 2\nk3 = 3\nk4 = 4\nk5 = 5\n\n# again\nk1 = 1\nk2  =  2\nk3 = 3\nk4 =\t4\nk5 = 5", [("QUALITY.DRY", "medium", 1)], [], 5, 0, 0)

#: By document id modulo 4: the tail of the file, its functions, the diff, and (change type, symbols, breaks (name, line in the tail, 0: none), orphans, public symbols).
TAILS: list[tuple[str, str | None, str, int, list[tuple[str, int]], list[str], int]] = [
    ("# the end", None, "", 0, [], [], 0),
    ("# the end", "@@ -1,2 +1 @@\n-def gone_away(a):\n-    return a\n+x9 = 1", "refactor", 1, [("gone_away", 0)], [], 1),
    ("def _lonely(q):\n    return q", "@@ -1 +1,2 @@\n+def _lonely(q):\n+    return q", "feature", 1, [], ["_lonely"], 0),
    ("def resize_it(img, size):\n    return img", "@@ -1 +1 @@\n-def resize_it(img):\n+def resize_it(img, size):  # a hotfix", "bugfix", 1, [("resize_it", 1)], [], 1),
]
N = len(SNIPPETS)


def _pick(values: list[str | None], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int") + 1)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file_path, content, diff): one file per document."""
    d, key = spread(table(spark, sf_dir, "documents").select("doc_id")), F.col("doc_id")
    one = key % N
    two = (one + 1 + F.floor(key / N) % (N - 1)) % N
    texts = [s[0] for s in SNIPPETS]
    tail = F.floor(key / 3) % 4
    content = F.concat(_pick(texts, one), F.lit("\n"), _pick(texts, two), F.lit("\n"), _pick([t[0] for t in TAILS], tail))
    return d.select("doc_id", F.concat(F.lit("src/m"), key.cast("string"), F.lit(".py")).alias("file_path"), content.alias("content"), _pick([t[1] for t in TAILS], tail).alias("diff"))


def _rows(rows: list[tuple]) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


#: parts: each file's snippets with the lines before them; the tables of what the snippets and tails give.
SOURCES_SQL = f"""sizes(s, lines, q, p, t) AS (VALUES {_rows([(i, s[0].count(chr(10)) + 1, *s[3:]) for i, s in enumerate(SNIPPETS)])}),
given(s, rule_id, severity, line) AS (VALUES {_rows([(i, *f) for i, s in enumerate(SNIPPETS) for f in s[1]])}),
functions(s, name, line, last, complexity, loops, params, rec) AS (VALUES {_rows([(i, *f) for i, s in enumerate(SNIPPETS) for f in s[2]])}),
files AS (SELECT doc_id, 'src/m' || doc_id || '.py' AS file_path, (doc_id % {N}) AS s1, ((doc_id % {N}) + 1 + (doc_id // {N}) % {N - 1}) % {N} AS s2, (doc_id // 3) % 4 AS tail FROM documents),
parts AS (SELECT doc_id, file_path, s1 AS s, 0 AS before FROM files UNION ALL SELECT doc_id, file_path, s2, z.lines FROM files JOIN sizes z ON z.s = s1),
ends AS (SELECT f.*, a.lines + b.lines AS before FROM files f JOIN sizes a ON a.s = s1 JOIN sizes b ON b.s = s2)"""
