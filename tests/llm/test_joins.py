"""The Jaccard join against all pairs, and components."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import common, components, jaccard_join


def near_copies(seed, groups, copies, words=60, edits=3):
    """Groups of texts a few edits from a base, so that some link and some only by way of others."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.randint(0, edits)):
                k = rnd.randrange(len(own))
                own[k : k + rnd.randint(0, 1)] = [word()] * rnd.randint(0, 2)
            rows.append(" ".join(own))
    rnd.shuffle(rows)
    return list(enumerate(rows))


def joined(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, **how).collect()}


@pytest.mark.parametrize("seed,groups,copies,words,edits", [(1, 12, 8, 60, 3), (2, 2, 90, 110, 4), (3, 30, 4, 9, 1)])
def test_join_is_all_pairs(spark, seed, groups, copies, words, edits):
    rows = near_copies(seed, groups, copies, words, edits)
    got = joined(spark, rows)
    assert {k: c for k, (_, c) in got.items()} == brute.components(rows)
    assert all(got[k][0] == len(brute.shingles(t)) for k, t in rows)


def test_join_edge_cases(spark):
    rows = [(None, "a b c d"), (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\ttwo"), (8, "é b c"), (9, "É b c"), (9, "É b c"), (10, "w " * 50_000), (None, "a b c d")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component_id int")
    found = sorted(jaccard_join.join(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert len(found) == len(rows)
    assert [(r.doc_id, r.component_id) for r in found] == [(None, None), (None, None), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6), (8, 8), (9, 9), (9, 9), (10, 10)]
    assert found[2].n_shingles == 0 and found[5].n_shingles == 1
    assert jaccard_join.join(docs.limit(0)).count() == 0
    kept = jaccard_join.one_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 8, 9, 10]


def test_join_takes_any_long_as_id(spark):
    top = 2**63 - 1
    ids = lambda k: (top - k) if k % 2 else (-top + k)
    rows = [(ids(k), t) for k, t in near_copies(4, 6, 6, 50, 2)]
    assert {k: c for k, (_, c) in joined(spark, rows).items()} == brute.components(rows)


def test_texts_of_one_document_are_linked_through_it(spark):
    a, b, c = ("one two three four five", "six seven eight nine", "ten eleven twelve")
    got = joined(spark, [(3, a), (9, a), (9, b), (12, b), (20, c), (21, c), (21, c)])
    assert {k: x for k, (_, x) in got.items()} == {3: 3, 9: 3, 12: 3, 20: 20, 21: 20}


def test_a_group_larger_than_a_chunk_is_one_component(spark):
    rows = near_copies(8, 1, 150, 80, 3)
    assert {k: c for k, (_, c) in joined(spark, rows, chunk=500).items()} == brute.components(rows)


def test_linked_sets_share_a_signature():
    """Pigeonhole for every split of exact and one-deletion segments."""
    shingle, rnd = jaccard_join.Shingler(1), random.Random(5)
    for share in (0.0, 0.5, 1.0):
        signer = jaccard_join.Signer(90, lambda _, s=share: s)
        for _ in range(200):
            words = [str(rnd.random()) for _ in range(rnd.randint(1, 120))]
            other = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 15))):
                other[rnd.randrange(len(other))] = str(rnd.random())
            other += [str(rnd.random()) for _ in range(rnd.randint(0, max(0, len(words) // 20)))]
            a, b = shingle(" ".join(words)), shingle(" ".join(other))
            both = len(set(a.tolist()) & set(b.tolist()))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                x, y = ({s for _, sigs in signer(v) for s in sigs.tolist()} for v in (a, b))
                assert x & y
                (p, *one), (q, *two) = signer.sketch(a), signer.sketch(b)
                apart = sum(u != v for u, v in zip(one[p < q], two[q < p], strict=True))
                assert abs(p - q) <= 1 and 190 * apart <= 10 * (len(a) + len(b))


def test_a_column_is_shingled_and_signed_as_its_texts_are():
    rnd = random.Random(6)
    long = "x" * jaccard_join.LONG_WORD
    texts = ["a b c", None, "", " \t\n", "one", "ONE", "É é\x0bÉ", "a  b\r\nc ", "ab c d", "a bc d", long, f"{long} {long}y {long}z", "w " * 500, "12345678 123456789", "12345678 12345678\0"]
    texts += [" ".join(str(rnd.randrange(50)) for _ in range(rnd.randint(1, 300))) for _ in range(60)]
    shingle, column = jaccard_join.Shingler(3), pa.array(["left out", *texts])[1:]
    alone = [shingle(t) for t in texts]
    assert [len(x) for x in alone] == [len(brute.shingles(t)) for t in texts]
    known = [brute.shingles(t) for t in texts]
    assert all((known[k] == known[m]) == np.array_equal(alone[k], alone[m]) for k in range(len(texts)) for m in range(k))
    for size in (1, 700, 1 << 20):
        assert all(np.array_equal(x, y) for x, y in zip([x for part in shingle.column(column, size) for x in part], alone, strict=True))
    sets = [x for x in alone if len(x)]
    for share in (0.0, 0.5, 1.0):
        signer = jaccard_join.Signer(90, lambda _, s=share: s)
        got = [[] for _ in sets]
        for place, sigs in signer.all(sets):
            for k, x in zip(place.tolist(), sigs.tolist(), strict=True):
                got[k].append(x)
        assert [sorted(x) for x in got] == [sorted(s for _, sigs in signer(items) for s in sigs.tolist()) for items in sets]
    assert list(shingle.column(column[:0])) == [] and list(signer.all([])) == []


def test_components(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(140)] + [(k, k + 1) for k in range(300, 340)] + [(None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    assert got == {k: find(k) for k in root}


def test_a_hot_key_is_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_IDS", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 7)
    rows = spark.createDataFrame([(k % 2 if k < 90 else k, k) for k in range(100)] + [(None, 1)], "key long, x long")
    lookup = spark.createDataFrame([(k, -k) for k in range(95)], "key long, y long")
    got = common.join_hot(rows, lookup, ["key"], 95, "left")
    assert got.columns == ["key", "x", "y"]
    want = [(None, 1, None)] + [((k % 2 if k < 90 else k), k, (-(k % 2) if k < 90 else -k if k < 95 else None)) for k in range(100)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert common.join_hot(rows, lookup, ["key"], 95).count() == 95


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, a, "x"), (9, a, "y"), (9, b, "y"), (9, b, "y"), (12, c, "z"), (15, b, "q"), (None, c, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = jaccard_join.one_each(docs)
    assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert sum(t == b for _, t in found) == 1 and sum(t == a for _, t in found) == 1
    assert (12, c) in found and (None, c) in found and len(found) == 4


def test_components_of_few_edges_take_few_tasks(spark):
    """Each shuffle costs the driver a task a partition, and what it keeps of tasks takes its memory."""
    edges = spark.createDataFrame([(k, k // 2) for k in range(1, 64)], "a long, b long").coalesce(1)
    conf = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, sc = {k: spark.conf.get(k) for k in conf}, spark.sparkContext
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few-edges", "few edges")
        got = {r.node: r.root for r in components.components(edges).collect()}
        tracker = sc.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup("few-edges") for s in tracker.getJobInfo(job).stageIds}
        tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == dict.fromkeys(range(64), 0)
    assert tasks <= 450


@pytest.mark.parametrize("bound", [1_000_000, 3])
def test_components_are_extended_by_what_ties_them(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "BROADCAST_IDS", bound)
    monkeypatch.setattr(components, "BROADCAST_IDS", bound)
    rnd = random.Random(5)
    one, two = ([(rnd.randrange(400), rnd.randrange(400)) for _ in range(n)] for n in (150, 60))
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    for more in (two, [(None, 3), (7, None)]) if bound > 3 else [two]:
        got = [tuple(r) for r in components.extended(components.components(frame(one)), frame(more)).collect()]
        want = {r.node: r.root for r in components.components(frame(one + more)).collect()}
        assert len(got) == len(set(got)) and dict(got) == want
