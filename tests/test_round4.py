"""Steps whose work must grow with the input alone: what they shuffle, copy and try."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.text import tokens, tokens_of, words
from tessera.operators import chain, chunking, retrieval, scan, trace

PROSE = ["the getHTTPResponse of a_b and __x 42 XMLHttp", "", None, "SSauheit a1B2 camelCase camelCase the", "é the 7up _ ABC Abc"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_taken_apart_as_in_the_jvm(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(PROSE)], "i int, text string").select("text", tokens(F.col("text")).alias("t")).collect()
    assert all([t for w in words(r["text"] or "") for t in tokens_of(w)] == r["t"] for r in rows)


def test_hashed_vectors_need_no_shuffle(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PROSE)], "doc_id long, text string")
    made = retrieval.hashed(df, "doc_id", "text", "v", 16)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    lengths = {r["doc_id"]: math.sqrt(sum(x * x for x in r["v"])) for r in made.collect()}
    assert all(abs(lengths[i] - bool(words(t or ""))) < 1e-12 for i, t in enumerate(PROSE))


def test_scores_of_tables_and_of_lists_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the w{i % 7} {'of ' * (i % 3)} x{i % 5}") for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"w{i} x{i} of of") for i in range(5)], "item_id long, text string")
    dense = sorted(retrieval.bm25(docs, asked, 4).collect())
    monkeypatch.setattr(retrieval, "DENSE_CELLS", 0)
    assert dense and sorted(retrieval.bm25(docs, asked, 4).collect()) == dense


def test_neighbours_among_many_equal_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(5, 4))
    rows = [(i, v[i % 5].tolist()) for i in range(400)] + [(400, [0.0] * 4)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query"], r["place"]): r["key"] for r in retrieval.knn(e, e.filter("vec_id in (3, 7)"), 6).collect()}
    assert got == {(q, n + 1): k for q in (3, 7) for n, k in enumerate([i for i in range(400) if i % 5 == q % 5 and i != q][:6])}


def test_chunks_are_cut_before_they_are_rows(spark):
    files = spark.createDataFrame([("a", "\n".join(map(str, range(1, 11)))), ("b", " \n　\n"), ("c", None)], "path string, content string")
    cut = chunking.windows(files, window=4, overlap=1)
    assert "Generate inline" in _plan(cut)
    assert sorted((r["path"], r["start_line"], r["end_line"], r["text"]) for r in cut.collect()) == [("a", 1, 4, "1\n2\n3\n4"), ("a", 4, 7, "4\n5\n6\n7"), ("a", 7, 10, "7\n8\n9\n10")]


def test_plain_texts_meet_no_pattern(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\nab\n-----END RSA PRIVATE KEY-----"
    texts = [key, "akia" + "A1" * 8, "Asia" + "B2" * 8, "GLPAT-" + "x" * 20, "ghs_" + "q" * 20, "SK-" + "w" * 20, "xoxp-" + "1" * 10, "bearer " + "z" * 12, "Passwd: 'hunter22'", "api-key = \"abcdef\"", "MY_API_KEY=abcdefg", "my_Secret_Token = a1b2c3d4", "plain prose", None]
    out = scan.redact(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text")
    assert "Contains(" in _plan(out) or "CONTAINS" in _plan(out).upper()
    assert [r["masked"] for r in out.orderBy("i").collect()] == [1] * 12 + [0, 0]
    assert out.columns == ["i", "text", "redacted", "masked"]
    lines = [(1, "IMPORT   PDB"), (2, "see HTTP://x"), (3, "-----begin private key-----"), (4, "debug = true"), (5, "# eval(x)"), (6, "plain prose"), (7, "EVAL (x)")]
    found = scan.scan_lines(spark.createDataFrame(lines, "line int, body string"), F.lit("python"))
    assert "CONTAINS" in _plan(found).upper()
    assert sorted(r["line"] for r in found.collect()) == [1, 2, 3, 4, 7]


def test_rounds_take_along_open_spans_only(spark, monkeypatch):
    rows = [("t", str(i), str(i - 1) if i else "", "k", i, i + 1000 - i) for i in range(64)]
    rows += [(f"u{i}", "a", "", "k", 0, 1) for i in range(200)]
    spans, written = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, kind string, started_ms long, ended_ms long"), []
    real = trace.materialised
    monkeypatch.setattr(trace, "materialised", lambda df: (written.append(made := real(df)), made)[1])
    monkeypatch.setattr(trace, "dropped", lambda *tables: None)
    path = trace.critical_path(trace.resolved(spans)).collect()
    assert {(r["trace_id"], r["step"], r["span_id"]) for r in path} == {("t", i + 1, str(i)) for i in range(64)} | {(f"u{i}", 1, "a") for i in range(200)}
    sizes = [t.count() for t in written]
    assert sum(n > 64 for n in sizes) == 2  # the spans, and what the path needs of them; each round has fewer


def test_a_store_is_sealed_once_before_it_is_rewritten(spark):
    e = spark.createDataFrame([(c, i, f'{{"n": {i}}}') for c in range(3) for i in range(4)], "c long, o long, payload string")
    calls = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda p: (calls.add(1), p)[1], "string").asNondeterministic()
    sealed = chain.seal(e.withColumn("payload", counted("payload")), "c", "o", "payload")
    fresh, outcome = chain.rewrite(sealed, "c", "o", lambda d: chain.erase(d, F.col("sequence") == 2, "p", "t"))
    assert {(r["c"], r["kept"], r["changed"], r["refused"]) for r in outcome.collect()} == {(c, 4, 1, None) for c in range(3)}
    assert {r["status"] for r in chain.verify(fresh, "c", "o").collect()} == {"intact"} and fresh.count() == 12
    assert calls.value == 12
