"""Checkouts, fixed-string search, symbols, data flow and source chunks, on small hand-made cases."""

import ast
import os

import pytest

from tessera.operators import chunking, flow, search, symbols
from tessera.sources import checkout, workspace


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    files = {
        "b.py": b"x = 1\n", "a.go": b"caf\xe9\n", "nul.py": b"a\x00b", "rubble.py": b"\xff\xfe\xfd", "big.toml": b"k" * 500, "note.txt": b"no", "up.PY": b"no",
        "src/z.py": b"z\n", "src/deep/er/y.py": b"y\n", "build/gone.py": b"no", "src/.git/config.py": b"no", "src/.tox/t.py": b"no", ".mypy_cache/m.py": b"no",
        "id_x.py": b"no", "k/a.ppk": b"no", "conf/.env.local.py": b"no", "conf/deploy_rsa/x.py": b"no", "conf/APP.PEM/x.py": b"no", "conf/environment.py": b"e", "empty.sh": b"",
    }
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (tmp_path / "secret.py").write_text("out of the root")
    os.symlink(tmp_path / "secret.py", root / "escape.py")
    os.symlink(root / "id_x.py", root / "alias.py")
    os.symlink(root / "b.py", root / "same.py")
    os.symlink(root / "src", root / "loop")
    return root


def test_scan_survives_what_a_checkout_holds(spark, tree):
    found = workspace.files(spark, f"file:{tree}", max_file_bytes=100).orderBy("ordinal").collect()
    assert [r.path for r in found] == ["a.go", "b.py", "big.toml", "empty.sh", "same.py", "conf/environment.py", "src/z.py", "src/deep/er/y.py"]
    text = {r.path: r.content for r in found}
    assert text["a.go"] == "caf\ufffd\n" and text["empty.sh"] == "" and text["same.py"] == "x = 1\n"
    assert text["big.toml"] == "k" * 100 + "\n\n[... truncated: file is larger than 100 bytes, only the first 100 were read ...]"


def test_partitions_are_planned_by_bytes_and_budgets_refuse(spark, tree):
    checkout.register(spark)
    load = lambda **o: spark.read.format("checkout").options(**o).load(str(tree))
    assert load(partitionBytes=1).rdd.getNumPartitions() == 10 and load().rdd.getNumPartitions() == 1
    assert load(partitionBytes=1).orderBy("ordinal").collect() == load().orderBy("ordinal").collect()
    # 5 bytes for a.go and 6 for b.py, the 500 are refused, what is smaller behind them still fits.
    kept = [r.path for r in load(totalBytes=20).orderBy("ordinal").collect()]
    assert kept == ["a.go", "b.py", "empty.sh", "nul.py", "rubble.py", "conf/environment.py", "src/z.py"]
    assert list(checkout.within(iter([("a", 3), ("b", 9), ("c", 2)]), 5, 5)) == [(0, "a", 3, 3), (2, "c", 2, 2)]
    assert workspace.files(spark, str(tree / "nowhere")).count() == 0
    with pytest.raises(Exception, match="root"):
        spark.read.format("checkout").load().count()


def test_index_keeps_walking_order_and_caps(spark, tree):
    (tree / "src" / "c.py").write_text("@dec\nclass C:\n    def m(self):\n        pass\n\ndef f():\n    pass\n")
    files = workspace.files(spark, str(tree))
    cut = workspace.chunks(files)
    assert [(r.path, r.start_line, r.name) for r in cut.collect()][-6:] == [("src/c.py", 1, ""), ("src/c.py", 1, "C"), ("src/c.py", 3, "C.m"), ("src/c.py", 6, "f"), ("src/z.py", 1, ""), ("src/deep/er/y.py", 1, "")]
    assert workspace.chunks(files, max_files=2).select("path").distinct().count() == 2 and workspace.chunks(files, max_chunks=3).count() == 3


FILES = [
    ("src/a.py", "import pkg.mod\nx = pkg.mod.run(1)\nrunner = 2\n"), (".env", "run"), ("a/.env.x", "run"), ("node_modules/a.js", "run"), ("lib/build/b.c", "run"), ("build", "run here"),
    ("k/id_rsa", "run"), ("k/site.pem", "run"), ("yarn.lock", "run"), ("a.min.js", "run"), ("bin.py", "run\x00"), ("src/many.py", "run run\n" * 9 + "run"), ("none.py", None), ("e.py", ""),
]


@pytest.mark.parametrize("block", [50_000, 2])
def test_search_of_fixed_strings(spark, monkeypatch, block):
    monkeypatch.setattr(search, "AUTOMATON_PATTERNS", block)
    files = spark.createDataFrame(FILES, "path string, content string")
    patterns = spark.createDataFrame([(p,) for p in ("run", " pkg.mod\n", "mod.run", "-x", "a b", "..", "", None, "x" * 201, "un", "R")], "symbol string")
    got = sorted((r.symbol, r.path, r.line, r.body) for r in search.search(files, patterns, per_file=4).collect())
    many = [(s, "src/many.py", i, "run run") for s in ("run", "un") for i in (1, 2, 3, 4)]
    lines = FILES[0][1].split("\n")
    right = [("pkg.mod", "src/a.py", 1, lines[0]), ("pkg.mod", "src/a.py", 2, lines[1]), ("mod.run", "src/a.py", 2, lines[1])]
    right += [(s, "src/a.py", i, lines[i - 1]) for s in ("run", "un") for i in (2, 3)] + [(s, "build", 1, "run here") for s in ("run", "un")] + many
    assert got == sorted(right)
    assert search.search(files.limit(0), patterns).count() == 0 and search.search(files, patterns.limit(0)).count() == 0


def test_symbols_of_python():
    source = (
        "import os\nA = B = 1\nc: int = 2\nd: str\nx.y = 3\n(e, f) = 1, 2\nclass K(Base):\n    Z = 1\n    def m(self, a, /, b=1, *rest, c, **kw): inner = 1\n    if True:\n        def hidden(self): pass\n    class In:\n        async def n(cls, q): pass\n"
        "def m(other): pass\np.add_argument('-a', '--all', dest='--no')\nadd_argument('plain')\nos.getenv('ONE')\ngetenv(name)\nos.environ.get('TWO', 'x')\nd.get('NOT')\nself.env['THREE']\nenvironment[key]\n"
    )
    got = [told[:3] for told in symbols.python_names(source)]
    assert [t[1] for t in got if t[0] == "assigned"] == ["A", "B", "c", "d", "Z", "inner"]
    assert [t[1:] for t in got if t[0] == "method"] == [("K.m", ["a", "b", "c"]), ("In.n", ["q"])]
    assert {t[1] for t in got if t[0] == "function"} == {"m", "hidden", "n"} and {t[1] for t in got if t[0] == "class"} == {"K", "In"}
    assert [t[1] for t in got if t[0] == "option"] == ["-a", "--all"] and [t[1] for t in got if t[0] == "environment"] == ["ONE", "TWO", "THREE"]
    assert symbols.python_names("def (") == [] and symbols.python_names("") == [] and symbols.python_names("a\0") == []


def test_index_takes_the_first_bare_and_the_last_qualified_signature(spark):
    files = [("b.py", "def run(late): pass\nclass K:\n    def go(self, two): pass\n"), ("a.py", "class K:\n    def run(self, deep): pass\n    def go(self, one): pass\ndef run(top): pass\n"), ("c.ts", "export const run = 1\nlet other$ = 2\n"), ("d.py", None)]
    got = {(r.kind, r.name): r.params for r in symbols.index(symbols.names(spark.createDataFrame(files, "path string, content string"))).collect()}
    assert got == {("symbol", "run"): ["top"], ("symbol", "K"): None, ("symbol", "K.run"): ["deep"], ("symbol", "K.go"): ["two"], ("symbol", "go"): ["one"], ("symbol", "other"): None}


def taint(source):
    return [tuple(t) for t in flow.sql_taint(ast.parse(source))]


def test_taint_follows_names():
    chain = "a = f'select {x} from t'\nb = a\nc = b\nd = c\ne = d\ncur.execute(e)\n"
    assert taint(chain) == [(1, "e", "f-string", "select   from t", 6)]
    assert taint("q = 'select ' + x\nr = q\nq = 'safe'\ncur.execute(q)\ncur.execute(r)\n") == [(1, "r", "concatenation", "select ", 5)]
    assert taint("r = q\nq = 'select ' + x\ncur.execute(r)\n") == []
    # Told once, until it is cleared; a rebuild without that is not told again.
    assert [t[0] for t in taint("q = 'drop %s' % x\nc.execute(q)\nc.execute(q)\nq = 'drop {}'.format(x)\nc.execute(q)\nq = 1\nc.execute(q)\nq = 'drop ' + x\nc.execute(q)\n")] == [1, 8]
    assert taint("q = 'select 1 ' + 'from t'\nc.execute(q)\nc.execute('select ' + x)\nw = 'hello ' + x\nc.execute(w)\n") == []
    assert taint("cur.execute(q)\nq = 'select ' + x\n") == [] and taint("q = 'select ' + x\nq = cur.execute(q)\n") == [(1, "q", "concatenation", "select ", 2)]


def test_taint_keeps_to_its_scope():
    assert taint("def f():\n    q = 'select ' + x\ndef g():\n    cur.execute(q)\n") == []
    assert [t[0] for t in taint("if y:\n    q = 'select ' + x\n    try:\n        cur.execute(q)\n    except E:\n        pass\n")] == [2]
    assert [t[0] for t in taint("q = 'select ' + x\nif y:\n    def f():\n        cur.execute(q)\n")] == [1]
    assert taint("class C:\n    q = 'select ' + x\n    cur.execute(q)\n") == []
    assert taint("match y:\n    case 1:\n        q = 'select ' + x\ncur.execute(q)\n") == []
    deep = "q = 'select '" + " + x" * 900 + "\ncur.execute(q)\n"
    assert [t[:2] for t in taint(deep)] == [(1, "q")]


def test_chunks_of_any_line_end(spark):
    files = [("a.py", "import os\r\n\r\n@d\r\ndef f():\r\n    pass\r\n"), ("b.txt", "one\rtwo\u2028three\x0cfour\n"), ("c.py", "X = 1\n\n"), ("d.py", "def ("), ("e.py", ""), ("f.md", None)]
    got = {(r.path, r.start_line, r.end_line, r.name): r.text for r in chunking.sources(spark.createDataFrame(files, "path string, content string")).collect()}
    assert got == {("a.py", 1, 3, ""): "import os\n\n@d", ("a.py", 3, 5, "f"): "@d\ndef f():\n    pass", ("b.txt", 1, 4, ""): "one\ntwo\nthree\nfour", ("c.py", 1, 2, ""): "X = 1\n", ("d.py", 1, 1, ""): "def ("}
    lines = spark.createDataFrame([("x", "\n".join(map(str, range(95))))], "path string, content string")
    assert [(r.start_line, r.end_line) for r in chunking.windows(lines).orderBy("start_line").collect()] == [(1, 40), (31, 70), (61, 95)]


def test_a_corpus_names_all_bad_files(spark, tmp_path):
    from tessera.sources import stores

    good = {"a.yaml": "name: a\nfile: x.py\nexpect:\n  - {rule: R, line: 3}\n", "deep/b.yml": "name: b\nscope: ['*']\n", "note.txt": "- no case\n"}
    bad = {"c.yaml": "- a list\n", "deep/d.yaml": "name: d\nexpect:\n  - {rule: R, odd: 1}\n", "e.yaml": "name: [\n", "f.yaml": "name: f\nline_tolerance: many\n", "g.yaml": ""}
    for name, text in (good | bad).items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    with pytest.raises(ValueError) as told:
        stores.read_corpus(spark, str(tmp_path), stores.CORPORA["cases"])
    assert "5 bad cases" in str(told.value) and all(n in str(told.value) for n in bad) and "a.yaml:" not in str(told.value)
    for name in bad:
        (tmp_path / name).unlink()
    cases = {r.name: r for r in stores.read_corpus(spark, str(tmp_path), stores.CORPORA["cases"]).collect()}
    assert set(cases) == {"a", "b"} and cases["a"].expect[0].line == 3 and cases["b"].scope == ["*"] and cases["b"].expect is None
    listed = stores.read_corpus(spark, [str(tmp_path / "a.yaml")], stores.CORPORA["cases"])
    assert [r.name for r in listed.collect()] == ["a"] and listed.columns == list(cases["a"].asDict())
