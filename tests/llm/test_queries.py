"""The registered queries of the corpus operators, and the pipeline, against plain Python over whole small tables read from Parquet."""

import hashlib
import json

import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import brute_components, word_ids

from tessera.llm import media, packing, pii, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, documents): 80 real documents, and rows with nulls, empty, repeated, very long and odd texts."""
    folder = tmp_path_factory.mktemp("sf")
    real = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(80).collect()]
    long = " ".join(f"word{i % 977} the" for i in range(30_000))
    odd = [None, "", "", " ", "a", "漢字 かな " * 40, long, long + " end", "\t\n", "x" * 5000, "Mr John Smith, call 217-555-7713 or mail a.b@x.example.com. John Smith left.", "same\n" * 300]
    rows = real + [(10**9 + i, t, None, None, None if t is None else len(t)) for i, t in enumerate(odd)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{folder}/documents.parquet")
    known = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), {r[0]: r[1] for r in rows}


@pytest.fixture(scope="module")
def no_rows(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows_of(spark, name, folder):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, folder).collect()}


def test_queries_on_empty_tables(spark, no_rows):
    import corpus_pipeline

    for name, query in queries.QUERIES.items():
        assert query(spark, no_rows).count() == 0, name
    assert corpus_pipeline.run(spark, no_rows).count() == 0


def test_op1(spark, tables):
    folder, texts = tables
    got, order = rows_of(spark, "op1_fingerprints", folder), sorted(texts, reverse=True)
    assert len(got) == len(texts)
    clauses = lambda t: Counter(c for line in t.split("\n") for c in fingerprint_clauses(line))
    seen, errors = {}, []
    for at, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        # Equal fingerprints exactly where the multisets of paragraphs are equal.
        assert seen.setdefault(got[i].fingerprint, Counter(text.split("\n"))) == Counter(text.split("\n"))
        for near, other in ((got[i].near_edited, edited), (got[i].near_next, following)):
            one, two = clauses(text), clauses(other)
            right = 2 * sum((one & two).values()) / (sum(one.values()) + sum(two.values()))
            assert abs(near - right) <= 0.9 * (1 - right) + 1e-9
            errors.append((near - right) / max(1 - right, 1e-9) if right < 1 else 0.0)
    assert len(seen) == len({json.dumps(sorted(Counter((t or "").split("\n")).items())) for t in texts.values()})
    assert float(np.sqrt(np.mean(np.square(errors)))) < 0.25


def fingerprint_clauses(line):
    import re

    return re.split(r"(?<=[.!?,;:|] )", line)


def test_op2(spark, tables):
    """The distributed fit equals a dense one: the same statistics and features, one matrix, one solve."""
    folder, texts = tables
    got = rows_of(spark, "op2_quality", folder)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in texts}
    stats = {i: np.array(quality.statistics(t or "")) for i, t in texts.items()}
    fit = [i for i in texts if i in labels and fold[i] > 1]
    x, y = np.array([stats[i] for i in fit]), np.array([labels[i] for i in fit], dtype=float)
    mean, scale = x.mean(0), x.std(0)
    phases = quality._phases(len(quality.STATISTICS))
    dense = lambda s: quality._fourier((s - mean) / np.where(scale > 1e-9, scale, 1.0), phases)
    z = dense(x)
    weights = np.linalg.solve(z.T @ z + quality.RIDGE * len(fit) / 1000 * np.eye(z.shape[1]), z.T @ y)
    grid = np.linspace(-0.5, 1.5, quality.BINS + 1)[1:-1]
    held = [i for i in texts if i in labels and fold[i] == 1]
    at = lambda ids: np.searchsorted(grid, dense(np.array([stats[i] for i in ids])) @ weights, side="right")
    counts, sums = np.bincount(at(held), minlength=quality.BINS), np.bincount(at(held), weights=[labels[i] for i in held], minlength=quality.BINS)
    lean = np.clip(np.linspace(-0.5, 1.5, quality.BINS), 0, 1)
    levels = np.clip(quality.isotonic((sums + 0.05 * lean) / (counts + 0.05), counts + 0.05), 0, 1)
    ids = sorted(texts)
    for i, level in zip(ids, levels[at(ids)], strict=True):
        assert abs(got[i].score - level) < 1e-3 and got[i].held_out == (fold[i] == 0) and got[i].predicted == int(got[i].score >= 0.3)


def test_op3(spark, tables):
    folder, texts = tables
    got = rows_of(spark, "op3_pii", folder)
    found = {i: pii.find(t) for i, t in texts.items() if t}
    entities = sorted({e for f in found.values() for *_, k, v in f for e in pii.entities_of(k, v)})
    real, given, attempt = {v for _, v in entities}, {}, {e: 0 for e in entities}
    while open_ := [e for e in entities if e not in given]:  # as the operator's rounds: the least by kind and value keeps a surrogate
        drawn = {e: pii.surrogate(queries.PII_KEY, *e, attempt[e]) for e in open_}
        taken = set(given.values())
        for e in open_:
            if drawn[e] not in real and drawn[e] not in taken and e == min(o for o in open_ if drawn[o] == drawn[e]):
                given[e] = drawn[e]
            attempt[e] += 1
    for i, text in texts.items():
        expected, shift = text, 0
        initials = pii.initials_of([x[2:] for x in found.get(i, [])], given)
        for start, end, kind, value in found.get(i, []):
            new = pii.laid(queries.PII_KEY, kind, value, given, initials)
            expected, shift = expected[: start + shift] + new + expected[end + shift :], shift + len(new) - (end - start)
        assert got[i].text == expected and len(got[i].replaced) == len(found.get(i, []))
    assert len(set(given.values())) == len(given) > 3


def test_op4_op7(spark, tables):
    from tessera.llm import bpe

    folder, texts = tables
    encoding = bpe._encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    four, seven = rows_of(spark, "op4_bpe", folder), rows_of(spark, "op7_tokens", folder)
    for i, text in texts.items():
        raw = (text or "").encode()
        ids = np.asarray(encoding.encode_ordinary(text or ""), dtype="<u4")
        assert (four[i].n_tokens, four[i].ids_sha256, four[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())
        n = len(word_ids(text))
        assert (seven[i].n_bytes, seven[i].n_tokens, seven[i].over_limit) == (len(raw), n, n > 2048)


def peaks_by_hand(payload):
    """The peak pairs from a plain discrete Fourier transform, frame by frame."""
    samples = np.frombuffer(payload, dtype=np.uint8).astype(float) - 128
    window = np.hanning(media.WINDOW)
    turns = np.exp(-2j * np.pi * np.outer(np.arange(1, media.WINDOW // 2), np.arange(media.WINDOW)) / media.WINDOW)
    tops = []
    for at in range(0, len(samples) - media.WINDOW + 1, media.HOP):
        loud = np.abs(turns @ (samples[at : at + media.WINDOW] * window))
        tops.append((loud.max(), int(loud.argmax()) if loud.max() > 5e-4 else 0, loud))
    return tops


def test_op6(spark, tables):
    folder, texts = tables
    got = rows_of(spark, "op6_media", folder)
    for i, text in texts.items():
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.wav_bytes(payload)
        pairs = media.peak_pairs(payload)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (got[i].media_bytes, got[i].media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert got[i].feature == f"{len(pairs)}:{hashlib.sha256(','.join(map(str, pairs)).encode()).hexdigest()}"
        tops = peaks_by_hand(payload)
        for pair in pairs.tolist()[:200]:  # each end of a pair is the loudest bin of its frame, at least as loud as its neighbours
            frame, gap = pair >> 16, pair & 63
            for at, place in ((frame, pair >> 11 & 31), (frame + gap, pair >> 6 & 31)):
                loud, _, bins = tops[at]
                assert bins[place] >= loud - 2e-3 and 0 < gap < media.SPAN
                assert all(loud >= tops[n][0] - 2e-3 for n in (at - 1, at + 1) if 0 <= n < len(tops))


def check_pieces(pieces, texts):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    total = 0
    for i, held in by_doc.items():
        ids, at = np.asarray(word_ids(texts[i]) + [2], "<u4"), 0
        for p in sorted(held, key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
        total += at
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    return total, len(by_sequence)


def test_op8(spark, tables):
    folder, texts = tables
    total, sequences = check_pieces(queries.op8_packing(spark, folder).collect(), texts)
    tasks = spark.read.parquet(f"{folder}/documents.parquet").rdd.getNumPartitions()
    assert sequences <= total / (4096 - packing.BLOCK_SLACK / packing.BLOCK_WINDOWS) + 1 + 2 * tasks


def test_op9(spark, tables):
    folder, texts = tables
    got = rows_of(spark, "op9_sharding", folder)
    for i, text in texts.items():
        raw = (text or "").encode()
        assert (got[i].size, got[i].text_crc32, got[i].law, got[i].grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    counts = Counter(r.shard for r in got.values())
    assert set(counts) <= set(range(24)) and max(counts.values()) - min(counts[s] for s in range(24)) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(counts[s]))


def test_op10(spark, tables):
    folder, texts = tables
    got, expected = rows_of(spark, "op10_neardup", folder), brute_components(texts, 4)
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        n = len({tuple(words[j : j + 4]) for j in range(max(1, len(words) - 3))}) if words else 0
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, expected[i], expected[i] == i)


def test_pipeline_equals_brute_force(spark, tables):
    """run() row by row: documents that score enough, one of each group of near copies, surrogates in their texts, all ids packed once."""
    import corpus_pipeline

    folder, texts = tables
    scores = rows_of(spark, "op2_quality", folder)  # checked above
    kept = {i: t for i, t in texts.items() if scores[i].score >= queries.QUALITY_LEAST}
    groups = brute_components(kept, 5)
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    found = {i: pii.find(t) for i, t in kept.items() if t}
    entities = sorted({e for f in found.values() for *_, k, v in f for e in pii.entities_of(k, v)})
    table = {(r.kind, r.value): r.surrogate for r in pii.resolve(spark.createDataFrame(entities or [("x", "x")], "kind string, value string"), queries.PII_KEY).collect()}
    for i, places in found.items():
        initials = pii.initials_of([p[2:] for p in places], table)
        for start, end, kind, value in reversed(places):
            kept[i] = kept[i][:start] + pii.laid(queries.PII_KEY, kind, value, table, initials) + kept[i][end:]
    assert 5 < len(kept) < len(texts)
    check_pieces(corpus_pipeline.run(spark, folder).collect(), kept)


def test_pipeline_stages_take_odd_rows(spark, tables):
    import corpus_pipeline

    folder, _ = tables
    names = ("__id", "__score", "__said", "__text", "__given", "__h1", "score", "replaced", "c0", "key", "id")
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({n: F.lit(n) for n in names})
    docs = docs.union(docs.limit(3)).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).select(docs.columns))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


