"""Alignment of tokenizers, exact k-means and SimHash against brute force: nulls, odd texts, ties, repeats, empty tables, clashing names."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from tessera.llm import alignment, queries, simhash, yinyang

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", "a ", " a", "a  b ", "tab\t x\n  y \n", "<s>a</s> <|endoftext|>x", "漢字 かな漢字" * 30, "é é ﬁ ①", "a\x00b", "x▁y", "▁", "﻿x", "don't  stop  now", "it's 12345 67,8!!",
    "word " * 500, "ab" * 5000, "\n\n\n", "   x", "The same text, twice.", "The same text, twice.", "x" + " " * 300 + "y", "🙂 emoji 👩‍👩‍👧 z‍",
]


@pytest.fixture(scope="module")
def texts(spark):
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    return dict(enumerate([*ODD, *real]))


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    place = tmp_path_factory.mktemp("sf")
    rows = [(i, t, i, "n", "g") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, row long, n_links string, groups string").repartition(5).write.parquet(f"{place}/documents.parquet")
    return str(place)


def aligned(text):
    """(A ids, B ids, groups, links) from the libraries and plain loops."""
    if not hasattr(aligned, "a"):
        aligned.a, aligned.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        aligned.a.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        aligned.byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    if not text:
        return [], [], [], []
    a, b = aligned.a.encode(" " + text, add_special_tokens=False).ids, aligned.b.encode(text)
    a_bytes = [bytes(aligned.byte[c] for c in aligned.a.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(p[3:5], 16)]) if aligned.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [aligned.b.id_to_piece(i)]]
    whole = (" " + text).encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return [], [], [], []
    spans = [[(sum(map(len, x[:i])), sum(map(len, x[: i + 1]))) for i in range(len(x))] if len(x) < 3000 else [(e - len(t), e) for t, e in zip(x, np.cumsum(list(map(len, x))).tolist())] for x in (a_bytes, b_bytes)]
    links, j = [], 0
    for i, (low, high) in enumerate(spans[0]):
        while j and spans[1][j - 1][1] > low:
            j -= 1
        while j < len(b) and spans[1][j][0] < high:
            if spans[1][j][1] > low:
                links.append((a[i], b[j]))
            j += 1
    ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, start = [], 0
    for end in ends:
        groups.append(([t for t, (x, _) in zip(a, spans[0]) if start <= x < end], [t for t, (x, _) in zip(b, spans[1]) if start <= x < end]) if len(ends) < 2000 else (start, end))
        start = end
    return a, b, groups, links


def test_label_string():
    label = alignment.labels(np.array([2, 3, 6]), np.array([1, 3, 6]))
    assert label == bytes([0b10, 0b01, 0b11, 0, 0, 0b11])
    assert [x.tolist() for x in alignment.group_sizes(label)] == [[3, 3], [2, 1], [2, 1]]
    assert alignment.links(label, np.array([7, 8, 9]), np.array([1, 2, 3])).tolist() == [7 << 32 | 1, 7 << 32 | 2, 8 << 32 | 2, 9 << 32 | 3]


@pytest.mark.parametrize("head", [1 << 19, 0, 50])
def test_alignment_equals_brute_force(spark, folder, texts, monkeypatch, head):
    monkeypatch.setattr(alignment, "HEAD_PAIRS", head)
    right = {i: aligned(t) for i, t in texts.items()}
    held = Counter(pair for *_, links in right.values() for pair in set(links))
    top = Counter()
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    got = {r.doc_id: r for r in queries.op11_alignment(spark, folder).collect()}
    assert len(got) == len(texts)
    for i, (a, b, groups, links) in right.items():
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(groups), len(links)), texts[i]
        assert r.count_sum == sum(held[p] for p in links) and r.n_best == sum(held[p] == top[p[0]] for p in links)
        if len(groups) < 2000:
            line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            assert r.groups_sha256 == (hashlib.sha256(line.encode()).hexdigest() if line else "")


def test_group_ends_are_bytes_of_the_text(spark, texts):
    rows = [(i, t, "x") for i, t in texts.items()]
    for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string, groups string"), A, B).collect():
        groups = r.groups.split(";") if r.groups else []
        assert len(groups) == len(r.group_ends) and (not groups or r.group_ends[-1] == len(f" {r.text}".encode()))
    assert alignment.align(spark.createDataFrame([], "text string"), A, B).count() == 0


def test_long_runs_are_cut_where_nothing_merges(monkeypatch):
    tool = alignment.Aligner(A, B)
    texts = ["漢字かな、word" * 400, "a1b2-c3" * 900, "x" * 5000, "é" * 3000, "\n\t" * 2000]
    whole = [tool.tokens(t) for t in texts]
    assert all(a and b for a, b in whole)
    monkeypatch.setattr(alignment, "SEGMENT_CHARS", 100)
    tool = alignment.Aligner(A, B)
    assert [tool.tokens(t) for t in texts] == whole


def lloyd(vectors, k, rounds, salt="1"):
    """(cluster, distance per vector, centroids) by full scans in whole numbers of any size."""
    order = sorted(vectors, key=lambda kv: (hashlib.sha256(f"{salt}:{kv[0]}".encode()).hexdigest(), kv[1]))
    places = [list(v) for _, v in order[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    assign = lambda: [min(range(len(places)), key=lambda c: (far(v, places[c]), c)) for _, v in vectors]
    for _ in range(rounds):
        at = assign()
        for c in range(len(places)):
            mine = [v for (_, v), x in zip(vectors, at, strict=True) if x == c]
            if mine:
                places[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = assign()
    return at, [far(v, places[c]) for (_, v), c in zip(vectors, at, strict=True)], places


@pytest.mark.parametrize("seed,k,components,rounds", [(1, 16, 4, 3), (2, 5, 2, 6), (3, 16, 8, 0), (4, 40, 3, 4)])
def test_clusters_equal_full_scans(spark, seed, k, components, rounds):
    r = np.random.default_rng(seed)
    rows = [(int(i), r.integers(-6, 7, components).astype(float).tolist(), "x") for i in range(400)]  # coarse, so distances tie
    rows += [(1000 + i, rows[7][1], "x") for i in range(150)] + [(7, rows[7][1], "x")]
    bad = [(2000, None), (2001, []), (2002, [1.0]), (2003, [float("nan")] * components), (2004, [float("inf")] + [0.0] * (components - 1)), (2005, [None] + [0.0] * (components - 1))]
    df = spark.createDataFrame(rows + [(i, v, "x") for i, v in bad], "vec_id long, embedding array<double>, cluster string").repartition(6)
    got = yinyang.cluster(df, k=k, components=components, scale=1.5, rounds=rounds).collect()
    kept = [(i, [int(np.floor(1.5 * x)) for x in v]) for i, v, _ in rows]
    at, far, places = lloyd(kept, k, rounds)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in places]
    of = Counter()
    for c, d in zip(at, far, strict=True):
        of[c] += d
    right = [(i, c, d, of[c], sum(far), digest[c]) for (i, _), c, d in zip(kept, at, far, strict=True)]
    assert sorted(map(tuple, got)) == sorted(right)


def test_bounds_save_measurements_and_hold():
    r = np.random.default_rng(5)
    places = r.integers(-300, 300, (24, 16))
    vectors = (places[r.integers(0, 24, 3000)] + r.normal(0, 20, (3000, 16))).astype(np.int64)
    group = yinyang.grouped(places)
    nearest, upper, lower = yinyang.first_bounds(vectors, places, group)
    moved_to = places + r.integers(-8, 9, places.shape)
    moved = np.sqrt(np.square(moved_to - places).sum(axis=1))
    nearest, upper, lower, measured = yinyang.next_bounds(vectors, nearest, upper, lower, moved_to, moved, group)
    every = np.stack([yinyang.squared(vectors, c) for c in moved_to], axis=1)
    assert (nearest == every.argmin(axis=1)).all() and measured < every.size / 4
    real = np.sqrt(every)
    assert (upper >= real[np.arange(3000), nearest]).all()
    real[np.arange(3000), nearest] = np.inf
    assert all((lower[:, g] <= real[:, group == g].min(axis=1)).all() for g in range(group.max() + 1))


def test_clusters_of_odd_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert yinyang.cluster(none).collect() == [] and yinyang.cluster(none).columns[0] == "vec_id"
    few = spark.createDataFrame([(1, [0.0, 1.0]), (None, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id or 0, r.cluster, r.distance) for r in yinyang.cluster(few, components=2, scale=1).collect()) == [(0, 0, 1), (1, 0, 0)]
    with pytest.raises(Exception, match="component"):
        yinyang.cluster(spark.createDataFrame([(1, [1e30, 1.0])], "vec_id long, embedding array<double>"), components=2).collect()


def prints_of(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def reach(prints, radius):
    """The smallest id that each id reaches, by all pairs."""
    ids = sorted(prints)
    label = {i: i for i in ids}
    near = [(i, j) for n, i in enumerate(ids) for j in ids[n + 1 :] if (prints[i] ^ prints[j]).bit_count() <= radius]
    moved = True
    while moved:
        moved = False
        for i, j in near:
            low = min(label[i], label[j])
            if (label[i], label[j]) != (low, low):
                label[i] = label[j] = low
                moved = True
    return label


def test_simhash_query_equals_brute_force(spark, folder, texts):
    prints = {i: prints_of(t) for i, t in texts.items()}
    right = reach(prints, 3)
    got = {r.doc_id: r for r in queries.op13_simhash(spark, folder).collect()}
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", right[i]) for i in texts}


def families(seed, n):
    """Random fingerprints, and families that walk away from one by a few bits."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        x = r.getrandbits(64)
        out.append(x)
        for _ in range(r.choice([0, 0, 3, 12])):
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
            out.append(x)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("large,depth", [(4096, 2), (8, 2), (8, 0), (2, 1)])
def test_links_connect_what_is_near(spark, monkeypatch, large, depth):
    """With small buckets, all that a deal leaves over goes through further deals and slices."""
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "DEPTH", depth)
    prints = dict(enumerate(families(7, 60)))
    prints |= {1000 + i: 0xABCDEF0123456789 ^ (i << 3) for i in range(48)}
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()]
    links = simhash.near_links(spark.createDataFrame(signed, "id long, fp long")).collect()
    assert all((prints[a] ^ prints[b]).bit_count() <= 3 for a, b in links)
    edges = {i: i for i in prints}
    for _ in prints:
        for a, b in links:
            edges[a] = edges[b] = min(edges[a], edges[b])
    assert edges == reach(prints, 3)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6, 7])
def test_bit_sliced_distances(monkeypatch, radius):
    monkeypatch.setattr(simhash, "AT_ONCE", 64)
    prints = np.array(families(radius, 40), dtype=np.uint64)
    n = len(prints)
    one, two = simhash.near_pairs(prints, np.arange(n) + 1, np.full(n, n), radius)
    assert all((int(prints[a]) ^ int(prints[b])).bit_count() <= radius for a, b in zip(one, two, strict=True)) and len(one) < n
    label = {i: i for i in range(n)}
    for _ in range(n):
        for a, b in zip(one.tolist(), two.tolist(), strict=True):
            label[a] = label[b] = min(label[a], label[b])
    assert label == reach(dict(enumerate(map(int, prints))), radius)


def test_a_dense_bucket_gives_a_forest():
    """3,000 fingerprints that are nearly all linked: the links passed on stay fewer than the members."""
    prints = np.unique(np.random.default_rng(1).integers(0, 1 << 12, 3000).astype(np.uint64))
    one, _ = simhash.near_pairs(prints, np.arange(len(prints)) + 1, np.full(len(prints), len(prints)))
    assert len(one) == len(prints) - 1


def test_simhash_of_odd_tables(spark):
    schema = "doc_id long, text string, fp string, component string"
    assert simhash.classes(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, "a b c d", "x", "y"), (5, "quite another text here", "x", "y"), (2, "A  b\tc D", "x", "y"), (None, "a b c d", "x", "y"), (9, None, "x", "y"), (8, " \n", "x", "y"), (7, "quite another TEXT here", "x", "y")]
    got = sorted(((r.id or 0, r.component) for r in simhash.classes(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(0, None), (2, 2), (5, 2), (5, 2), (7, 2), (8, 8), (9, 8)]
    text = " ".join(f"w{i}" for i in range(70_000))  # more shingles than are hashed at once
    assert simhash.fingerprint(text) == prints_of(text)
