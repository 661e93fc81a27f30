"""List ranking of long paths, recall in large directories, and what a policy decides."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import history, trace
from tessera.plans import policy


def test_a_path_of_ten_thousand_spans(spark):
    n = 10_000
    chain = spark.range(n).select(F.lit("t").alias("trace_id"), F.format_string("s%05d", "id").alias("span_id"), F.when(F.col("id") > 0, F.format_string("s%05d", F.col("id") - 1)).alias("parent"), F.lit(0).alias("started_ms"), F.lit(9).alias("ended_ms"))
    twigs = spark.range(0, n, 7).select(F.lit("t").alias("trace_id"), F.format_string("x%05d", "id").alias("span_id"), F.format_string("s%05d", "id").alias("parent"), F.lit(0).alias("started_ms"), F.lit(8).alias("ended_ms"))
    lone = spark.createDataFrame([("u", "r", None, 0, None), ("u", "a", "r", 5, 9), ("u", "b", "r", 2, 6), ("u", "c", "r", 2, 6), ("v", "only", None, 1, 2)], "trace_id string, span_id string, parent string, started_ms int, ended_ms int")
    found = trace.critical_path(chain.unionByName(twigs).unionByName(lone)).collect()
    long = sorted((r.step, r.span_id) for r in found if r.trace_id == "t")
    # The last span of the chain has no child but a twig, if its number is one of theirs.
    assert long[:n] == [(i + 1, f"s{i:05d}") for i in range(n)] and long[n:] == ([(n + 1, f"x{n - 1:05d}")] if (n - 1) % 7 == 0 else [])
    assert sorted((r.trace_id, r.step, r.span_id) for r in found if r.trace_id != "t") == [("u", 1, "r"), ("u", 2, "b"), ("v", 1, "only")]
    assert trace.critical_path(chain.limit(0)).count() == 0


def test_recall_in_a_large_directory(spark):
    today, day = dt.date(2024, 5, 1), dt.date(2024, 4, 1)
    schema = "kind string, file_path string, rule_id string, first_seen date, last_seen date, severity string, occurrences long, reason string"
    files = [("finding", f"d/f{i:04d}.py", "R", day, day, "low", 1 + i % 7, "") for i in range(3000)]
    loud = [("finding", "d/loud.py", f"L{i}", day, day, "critical", 90 + i, "") for i in range(40)]
    rows = [*files, *loud, ("finding", "top.py", "R", day, day, "low", 1, ""), ("finding", "other.py", "R", day, day, "low", 5, "")]
    past = spark.createDataFrame(rows, schema)
    paths = spark.createDataFrame([("d/loud.py",), ("d/f0001.py",), ("d/new.py",), ("top.py",), ("x/none.py",)], "path string")
    got = {}
    for r in history.recall_for(paths, past, F.lit(today), limit=8).orderBy("path", "place").collect():
        got.setdefault(r.path, []).append((r.file_path, r.rule_id, r.tier))
    best = [("d/loud.py", f"L{39 - i}") for i in range(8)]
    assert got["d/loud.py"] == [(*b, 0) for b in best] and got["d/new.py"] == [(*b, 1) for b in best]
    assert got["d/f0001.py"] == [("d/f0001.py", "R", 0), *((*b, 1) for b in best[:7])]
    assert got["top.py"] == [("top.py", "R", 0)] and "x/none.py" not in got
    # Without the loud file's own rows, the quiet files of seven sightings are what it would be told of.
    quiet = history.recall_for(paths.filter("path = 'd/loud.py'"), past.filter("file_path <> 'd/loud.py' or rule_id = 'L0'"), F.lit(today), limit=3).orderBy("place").collect()
    assert [r.file_path for r in quiet] == ["d/loud.py", "d/f0006.py", "d/f0013.py"]


def test_a_policy_decides(spark):
    made = {name: dict(keys) for name, keys in policy.DEFAULTS.items()}
    changes = spark.createDataFrame([("a.py", "+# a\n-# b"), ("b.py", "+x  = 1\n-x = 1"), ("test_c.py", "+assert f(1)\n"), ("d.sql", "+select 1"), ("e.py", "+if a:\n" * 12)], "path string, diff string")
    decide = lambda p: {r.path: r.decision for r in policy.triage(changes, p).collect()}
    assert decide(made) == {"a.py": "auto_approve", "b.py": "auto_approve", "test_c.py": "quick_scan", "d.sql": "auto_approve", "e.py": "quick_scan"}
    made["triage"] |= {"allow_only_comments": False, "allow_only_formatting": False, "allow_test_files": False, "max_lines_for_auto": 1, "max_lines_for_quick": 3, "manifest_patterns": [r"\.sql$"]}
    made["security"]["banned_patterns"] = ["assert"]
    assert decide(made) == {"a.py": "quick_scan", "b.py": "quick_scan", "test_c.py": "critical", "d.sql": "full_review", "e.py": "full_review"}


def test_the_gate_reads_prose_only_where_nothing_was_analysed(spark):
    fail, risk, score = "**SAST Scan Result**: FAIL - high", "**Risk Assessment**: [Critical]", "**SOLID Compliance**: {}/100"
    cases = [
        ("clean", "", True, "pass", 100), ("told", fail, True, "warn", 100), ("risky", risk, True, "warn", 100), ("low", score.format(10), True, "pass", 100), ("medium", "", True, "warn", 95), ("high", "", True, "warn", 90), ("worst", "", True, "fail", 80),
        ("none", "", False, "warn", None), ("unseen", fail + score.format(99), False, "fail", 99), ("unseen risk", risk + score.format(99), False, "fail", 99), ("good", score.format(60), False, "pass", 60), ("fair", score.format(55), False, "warn", 55), ("bad", score.format(49), False, "fail", 49),
        ("breaks", score.format(90) + "\nBreaking Changes**: Yes", False, "warn", 90), ("null", None, False, "warn", None), ("many", "", True, "fail", 40),
    ]
    reviews = spark.createDataFrame([c[:3] for c in cases], "file_path string, review string, analysed boolean")
    from tessera.functions import severity

    weights = {s[0]: s[2] for s in severity.SEVERITIES}
    found = [("medium", "medium"), ("high", "high"), ("worst", "critical")] + [("many", "medium")] * 12 + [("none", "critical")]
    got = {r.file_path: (r.result, r.quality, r.n_findings) for r in policy.gate(reviews, spark.createDataFrame(found, "file_path string, severity string"), policy.DEFAULTS).collect()}
    for name, _, analysed, result, quality in cases:
        mine = [s for f, s in found if f == name]
        right = max(0, 100 - sum(weights[s] for s in mine)) if analysed else quality
        assert got[name] == (result, right, len(mine) if analysed else None), name
    strict = {name: dict(keys) for name, keys in policy.DEFAULTS.items()}
    strict["gate"] |= {"blocking_severity": "medium", "fail_pipeline_on_critical": False, "quality_score_threshold": 61}
    strict["security"]["block_on_critical"] = False
    got = {r.file_path: r.result for r in policy.gate(reviews, spark.createDataFrame(found, "file_path string, severity string"), strict).collect()}
    assert {k: got[k] for k in ("medium", "risky", "unseen risk", "good", "breaks")} == {"medium": "fail", "risky": "pass", "unseen risk": "pass", "good": "warn", "breaks": "pass"}


def test_budgets_are_kept_in_order(spark, monkeypatch):
    """Running totals, later rounds and the row by row end give what one reader in order gives, for one large group and many small ones."""
    import random

    from tessera.operators import chunking

    r = random.Random(2)
    rows = [(g, i, f"p{i}", None if r.random() < 0.02 else "é" * r.choice([0, 1, 2, 5, 9, 30, 31, 200])) for i in range(1500) for g in [r.choice(["big"] * 8 + ["a", "b", "c"])]]
    df = spark.createDataFrame(rows, "group string, ordinal long, path string, content string").repartition(7)
    for rounds, total in ((4, 900), (1, 900), (0, 900), (4, 0), (2, 10**6)):
        monkeypatch.setattr(chunking, "BUDGET_ROUNDS", rounds)
        used, right = {}, {}
        for g, i, _, content in sorted(rows, key=lambda x: x[1]):
            text = (content or "")[:30]
            if used.get(g, 0) + len(text) <= total:
                used[g] = used.get(g, 0) + len(text)
                right[i] = text
        got = {x.ordinal: x.text for x in chunking.read_within(df, 30, total).collect()}
        assert len(got) == len(rows) and {i: t for i, t in got.items() if t is not None} == right, (rounds, total)


def test_a_sealed_store_does_not_fork(spark, tmp_path):
    import threading

    import pytest

    from tessera.operators import chain
    from tessera.sources import sealed

    path = str(tmp_path / "store")
    rows = lambda name, n: spark.createDataFrame([(c, i, f'{{"of":"{name}","i":{i}}}') for c in ("a", "b") for i in range(n)], "chain string, at long, payload string")
    with pytest.raises(ValueError, match="no commit"):
        sealed.read(spark, path)
    assert sealed.append(rows("first", 3), path, "chain", "at") == 1
    outcomes, gate = {}, threading.Barrier(2)

    def writer(name):
        gate.wait()
        try:
            outcomes[name] = sealed.append(rows(name, 4), path, "chain", "at", expected=1)
        except sealed.Conflict:
            outcomes[name] = None

    threads = [threading.Thread(target=writer, args=(n,)) for n in ("x", "y")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(outcomes.values(), key=str) == [2, None]
    held = sealed.read(spark, path)
    assert held.count() == 14 and {r.status for r in chain.verify(held, "chain", "sequence").collect()} == {"intact"}
    assert len(list((tmp_path / "store" / "data").iterdir())) == 2 and sealed.read(spark, path, 1).count() == 6
    # A stream, of which a batch comes twice.
    rows("stream", 5).write.parquet(str(tmp_path / "in"))
    write = sealed.batches("s", path, "chain", "at")
    query = spark.readStream.schema("chain string, at long, payload string").parquet(str(tmp_path / "in")).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    write(rows("stream", 5), 0)
    held = sealed.read(spark, path)
    assert held.count() == 24 and {(r.n, r.status) for r in chain.verify(held, "chain", "sequence").collect()} == {(12, "intact")}
    # Another writer between reading and committing: sealed again behind the new ends.
    commit, stolen = sealed._commit, []

    def late(*args):
        if not stolen:
            sealed._commit = commit
            stolen.append(sealed.append(rows("thief", 1), path, "chain", "at"))
        return commit(*args)

    sealed._commit = late
    try:
        assert sealed.append(rows("slow", 2), path, "chain", "at", attempts=2) == 5 and stolen == [4]
    finally:
        sealed._commit = commit
    assert {(r.n, r.status) for r in chain.verify(sealed.read(spark, path), "chain", "sequence").collect()} == {(15, "intact")}
