"""Prefix tries, centroid clustering and repeated byte strings against plain versions."""

import hashlib
import random

import brute_structures as brute
import numpy as np
import pytest

from sparkloom.llm import centroids, prefix_trie, queries, repeats

TURNS = "conv_id long, turn int, role string, text string"


def trie_rows(spark, rows, shard=prefix_trie.SHARD, schema=TURNS):
    found = prefix_trie.nodes(spark.createDataFrame(rows, schema).repartition(3), shard).collect()
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends.hex()) for r in found)


def dialogues(seed, convs, deepest, kinds):
    rnd = random.Random(seed)
    return [(c, t, rnd.choice(["user", "assistant"]), " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, kinds)))) for c in range(convs) for t in range(rnd.randint(1, deepest))]


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("seed,convs,deepest,kinds,shard", [(1, 120, 6, 1, 256), (2, 150, 7, 1, 3), (3, 80, 30, 2, 1), (4, 100, 5, 0, 2)])
def test_trie_is_the_plain_one(spark, seed, convs, deepest, kinds, shard):
    rows = dialogues(seed, convs, deepest, kinds)
    assert sorted(trie_rows(spark, rows, shard), key=key) == sorted(brute.trie(rows), key=key)


@pytest.mark.parametrize("shard", [1, 2, 256])
def test_trie_edge_cases(spark, shard):
    same = [(c, t, "user", "one two") for c in range(40, 60) for t in range(4)]
    rows = [(None, 1, "user", "x"), (0, 5, None, None), (0, None, "system", "s"), (1, 1, "", ""), (2, 1, "user", "w " * 50_000), (-5, 2, "user", "é 日本"), (-7, 1, None, "x"), (7, 1, "user", "only")]
    long = [(99, t, "user", f"turn {t % 3}") for t in range(300)]
    rows = rows + same + long
    assert sorted(trie_rows(spark, rows, shard), key=key) == sorted(brute.trie(rows), key=key)
    assert trie_rows(spark, [r for r in rows if r[0] is None], shard) == []
    # conversations without a turn left, and no other
    alone = next(c for c in range(21, 40) if prefix_trie.OPENING and __import__("zlib").crc32(str(c).encode()) % 4 > 0)
    rows = [(alone, 1, "user", "gone")]
    assert trie_rows(spark, rows, shard) == brute.trie(rows) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_trie_repeated_and_clashing(spark):
    rows = [(c, t, "user", "x", 7, "z") for c in range(5) for t in (1, 1, 2)]
    schema = "conv_id long, turn long, role string, text string, depth int, n_convs string"
    shuffled = rows[::-1]
    first, again = trie_rows(spark, rows, schema=schema), trie_rows(spark, shuffled, schema=schema)
    assert first == again and max(r[1] for r in first) == 3


def test_ends_of_a_hot_key_are_one_digest(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    ids = list(range(-50, 400)) + [2**63 - 1]
    rows = spark.createDataFrame([(b"k" if i % 3 else b"%d" % i, i) for i in ids], "key binary, conv_id long").repartition(5)
    got = {bytes(r.key): bytes(r.ends) for r in prefix_trie.ends(rows).collect()}
    want = {}
    for i in sorted(ids):
        want.setdefault(b"k" if i % 3 else b"%d" % i, []).append(str(i))
    assert got == {k: hashlib.sha256(",".join(v).encode()).digest() for k, v in want.items()}


def test_louds_gives_parents_back():
    seqs = [bytes([a]) * 20 + bytes([b]) * 20 for a in range(3) for b in range(a + 1)] + [b"z" * 20]
    trie, at = prefix_trie.build(np.array([0, 0, 0, 1, 1, 1, 1]), seqs)
    parents = trie.parents()
    assert trie.size == 2 * len(parents) + trie.roots and trie.degrees().sum() == len(parents)
    assert (np.diff(parents) >= 0).all() and all(parents[n - trie.roots] >= trie.roots for n in at[:-1])


def cluster_rows(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string").repartition(3)
    return sorted((tuple(r) for r in centroids.with_inertia(*centroids.cluster(df, **how)).collect()), key=key)


def test_clusters_are_the_plain_ones(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 0.15) + (i % 5) / 8 for _ in range(64)]) for i in range(300)]
    rows += [(1000 + i, [float(i % 2)] * 64) for i in range(40)]  # ties
    assert cluster_rows(spark, [(*r, "x") for r in rows]) == sorted(brute.clusters(rows), key=key)


@pytest.mark.parametrize("size", [1.0, 3e7, 1e30, 1e300])
def test_clusters_edge_cases(spark, size):
    rnd = random.Random(6)
    bad = [(1, None), (2, []), (3, [0.5] * 63), (4, [0.5] * 65), (5, [None] + [0.5] * 63), (6, [float("nan")] * 64), (7, [float("inf")] + [0.0] * 63)]
    rows = bad + [(None, [0.25] * 64), (9, [-0.001] * 64), (9, [0.5] * 64), (9, [0.5] * 64), (2**62, [-(2.0**-300)] * 64)] + [(20 + i, [size * rnd.uniform(-1, 1) for _ in range(64)]) for i in range(30)]
    assert cluster_rows(spark, [(*r, None) for r in rows]) == sorted(brute.clusters(rows), key=key)
    few = rows[:9]
    assert cluster_rows(spark, [(*r, None) for r in few]) == sorted(brute.clusters(few), key=key)
    assert cluster_rows(spark, [(*r, None) for r in bad]) == []


def test_screen_never_errs_and_mostly_decides():
    rnd = np.random.default_rng(7)
    for scale in (3, 1000, 2**26):
        points = rnd.integers(-scale, scale, (16, 64))
        vectors = np.concatenate([rnd.integers(-scale, scale, (500, 64)), (points[:8] + points[8:]) // 2, points])
        screen = centroids.Screen(points.tolist())
        best = screen.nearest(vectors)
        exact = ((vectors[:, None].astype(object) - points[None].astype(object)) ** 2).sum(axis=2)
        assert best.tolist() == [row.tolist().index(min(row)) for row in exact]
        assert screen.measured < 0.2 * 16 * screen.screened


def planted(seed, texts, size, alphabet="ab c"):
    rnd = random.Random(seed)
    some = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    common = [some(rnd.randint(size // 2, 3 * size)) for _ in range(5)]
    out = []
    for _ in range(texts):
        parts = [rnd.choice(common) if rnd.random() < 0.5 else some(rnd.randint(0, 2 * size)) for _ in range(rnd.randint(0, 5))]
        text = "".join(parts)
        if text and rnd.random() < 0.3:
            k = rnd.randrange(len(text))
            text = text[:k] + rnd.choice(alphabet) + text[k + 1 :]
        out.append(text)
    return list(enumerate(out + out[:3]))


def cut_rows(spark, rows, threshold, schema="doc_id long, text string", **how):
    docs = spark.createDataFrame(rows, schema).repartition(3)
    found = repeats.cut(docs, threshold, **how).collect()
    for r in found:
        assert all(a.stop < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))
    return sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), bytes(r.kept)) for r in found), key=key)


@pytest.mark.parametrize("seed,threshold,alphabet,slice_bytes", [(1, 20, "ab", 1 << 19), (2, 40, "abcdefgh ", 300), (3, 200, "abcdefghijkl ", 1000), (4, 13, "aé", 50), (5, 200, "ab", 1 << 19), (6, 2, "abcdefghijklmnopqrstuvwxyz0123456789", 100)])
def test_cut_is_the_plain_one(spark, seed, threshold, alphabet, slice_bytes):
    rows = planted(seed, 60, threshold, alphabet)
    assert cut_rows(spark, rows, threshold, slice_bytes=slice_bytes) == sorted(brute.repeats(rows, threshold), key=key)


def test_cut_edge_cases(spark):
    line = "".join(chr(97 + (k * k) % 23) for k in range(260))
    rows = [(None, line), (1, None), (2, ""), (3, "x" * 199), (4, "x" * 200), (5, "y" * 201), (5, "z" + line[:230]), (6, "w " * 20_000), (7, "日本語" * 100), (8, line), (8, "short")]
    got = cut_rows(spark, [(*r, 1, b"k") for r in rows], 200, "doc_id long, text string, n_bytes int, kept binary", slice_bytes=5000)
    assert got == sorted(brute.repeats(rows, 200), key=key)
    assert cut_rows(spark, rows[1:5], 200) == sorted(brute.repeats(rows[1:5], 200), key=key)
    assert repeats.cut(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_queries_are_the_plain_ones(spark):
    """The registered queries on whole small tables."""
    sf = "/root/testdata/sf0.001"
    table = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*cols).collect()]
    rows = lambda name: sorted((tuple(r) for r in queries.QUERIES[name](spark, sf).collect()), key=key)
    assert rows("op11_prefix_trie") == sorted(brute.trie(table("conversations", "conv_id", "turn", "role", "text")), key=key)
    assert rows("op12_centroid_clustering") == sorted(brute.clusters(table("embeddings", "vec_id", "embedding")), key=key)
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute.repeats(table("documents", "doc_id", "text"), 200)]
    assert rows("op13_suffix_dedup") == sorted(want, key=key)
