"""Queries do the whole of their job: each is held against brute force over all rows."""

import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import registry
from sparkloom.functions import fixed
from sparkloom.operators import entities, hrr, ranking
from sparkloom.plans.base import Tables

SF = "/root/testdata/sf0.01"


def normal(name):
    words = re.sub(r"[^\w\s]", " ", name.upper()).split()
    return [w for w in words if w not in fixed.NAME_SUFFIXES]


def kinds(a, b):
    """The tiers in which two names match."""
    if a and a == b:
        yield "exact"
    if a and set(a) == set(b):
        yield "fuzzy"
    a, b = ({w for w in x if len(w) >= 4} for x in (a, b))
    if len(a & b) >= 2 and len(a & b) >= 0.6 * len(a | b):
        yield "token_overlap"


@pytest.fixture(scope="module")
def sides(spark):
    t = Tables(spark, SF)
    return [{r.row_id: normal(r.name) for r in side.collect()} for side in (t.v_left, t.v_right)]


def test_every_part_is_on_a_side(spark, sides):
    left, right = sides
    keys = [r.p_partkey for r in spark.read.parquet(f"{SF}/part.parquet").collect()]
    assert sorted([*left, *right]) == sorted(keys)
    assert {r.row_id: r.normalized for r in registry.QUERIES["normalize_name"](spark, SF).collect()} == {k: " ".join(w) for k, w in left.items()}


def test_entities_are_matched_over_all_parts(spark, sides):
    left, right = sides
    alike = {(x, y): list(kinds(x, y)) for x in set(map(tuple, left.values())) for y in set(map(tuple, right.values()))}
    want = sorted((a, b, k) for a, x in left.items() for b, y in right.items() for k in alike[tuple(x), tuple(y)])
    found = registry.QUERIES["entity_resolution"](spark, SF).collect()
    assert sorted((r.left_row, r.right_row, r.match_type) for r in found) == want
    for name, kind in (("er_exact", "exact"), ("er_fuzzy", "fuzzy"), ("er_token_overlap", "token_overlap")):
        assert sorted((r.left_row, r.right_row) for r in registry.QUERIES[name](spark, SF).collect()) == [w[:2] for w in want if w[2] == kind]


def test_query_vectors_are_compared_with_all_vectors(spark):
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want = {(a, b): np.mean(np.cos(u - v)) for a, u in vectors.items() if a % 100 == 0 for b, v in vectors.items()}
    found = {(r.a, r.b): r.similarity for r in registry.QUERIES["hrr_similarity"](spark, SF).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-5 for k in want)


def test_every_order_gets_its_nearest_date(spark):
    orders, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    days = {}
    for r in lines.select("l_suppkey", F.to_date("l_shipdate").alias("day")).distinct().collect():
        days.setdefault(r.l_suppkey, []).append(r.day)
    events = orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day")).collect()
    want = sorted((r.o_orderkey, min(abs((r.day - d).days) for d in days[r.o_custkey])) for r in events if r.o_custkey in days)
    found = registry.QUERIES["nearest_event_distance"](spark, SF).collect()
    assert sorted((r.event_id, r.days) for r in found) == want and any(k % 20 for k, _ in want)


def test_pairs_are_made_by_blocks_and_stand_once(spark, monkeypatch):
    """Rows with several names, equal rows and frequent names over blocks of three: the pairs of a plain join, and no more in ``resolve``."""
    monkeypatch.setattr(entities, "BLOCK_ROWS", 3)
    monkeypatch.setattr(entities, "TASK_PAIRS", 20)
    names = ["goat wall river", "river goat wall", "goat wall", "oak", "", None]
    a = [(k, names[k % 3]) for k in range(20)] + [(1, "river goat wall"), (1, "goat wall river"), (2, "goat wall"), (30, "oak"), (None, "oak"), (31, ""), (32, None)]
    b = [(k, names[k % 2]) for k in range(15)] + [(1, "goat wall river"), (1, "goat wall"), (30, "oak"), (30, "oak"), (31, ""), (32, None)]
    left, right = (spark.createDataFrame(x, "row_id long, name string") for x in (a, b))
    all_pairs = [(x, y, k) for x, n in a for y, m in b for k in kinds(normal(n or ""), normal(m or ""))]
    order = lambda rows: sorted(rows, key=str)
    for made, kind in ((entities.equal_names(left, right, "norm", "exact"), "exact"), (entities.equal_names(left, right, "bag", "fuzzy"), "fuzzy")):
        assert order((r.left_row, r.right_row, r.match_type) for r in made.collect()) == order(p for p in all_pairs if p[2] == kind)
        assert made.rdd.getNumPartitions() > 1
    assert order((r.left_row, r.right_row, r.match_type) for r in entities.resolve(left, right).collect()) == order(set(all_pairs))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()

def test_pairs_are_taken_apart_in_the_jvm_a_slice_at_a_time(spark, monkeypatch):
    """No Python, no pairs shuffled or told apart afterwards; slices that don't divide the blocks lose nothing, nor do null ids."""
    monkeypatch.setattr(entities, "BLOCK_ROWS", 5)
    monkeypatch.setattr(entities, "LEFT_SLICE", 3)
    monkeypatch.setattr(entities, "RIGHT_SLICE", 2)
    a = [(k, "goat wall river") for k in range(23)] + [(None, "goat wall river"), (None, "oak"), (7, "river goat wall"), (8, "oak")]
    b = [(k, "river wall goat") for k in range(17)] + [(None, "goat wall river"), (3, "oak"), (3, "goat wall river")]
    left, right = (spark.createDataFrame(x, "row_id long, name string") for x in (a, b))
    found = entities.resolve(left, right)
    want = {(x, y, k) for x, n in a for y, m in b for k in kinds(normal(n), normal(m))}
    got = found.collect()
    assert sorted(((r.left_row, r.right_row, r.match_type) for r in got), key=str) == sorted(want, key=str)
    assert {(r.match_type, r.confidence) for r in got} == set(entities.CONFIDENCE.items())
    for made in (found, entities.equal_names(left, right, "bag", "fuzzy"), entities.shared_words(left, right)):
        plan = plan_of(made)
        assert "MapInArrow" not in plan and plan.index("Generate explode(right_rows") < plan.index("Generate explode(transform") < plan.index("Exchange")


def test_sentences_are_scored_where_their_text_is_read(spark):
    """No shuffle; exact fractions tell which sentences are best, the earlier of equal ones."""
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text and r.text.isascii()}
    rows = [*texts.items(), (-1, None), (-2, ""), (-3, "One two. Three four five six! one two three four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, best = {}, {}
    for key, text in rows:
        said = re.split(fixed.SENTENCE_END, (text or "").strip(" "))
        words = [re.findall(r"\w+", s.lower()) for s in said]
        count = Counter(w for s in words for w in s)
        for k, s in enumerate(words):
            if len(s) >= 4:
                tf = Fraction(sum(count[w] for w in set(s)), len(set(s)) * max(count.values()))
                want[key, k] = max(tf + max(Fraction(30 - 2 * k, 100), 0) - min(Fraction(len(s), 100), Fraction(1, 2)), Fraction(0))
        top = sorted(sorted((k for d, k in want if d == key), key=lambda k: (-want[key, k], k))[:3])
        if top:
            best[key] = (top, " ".join(said[k].strip(" ") for k in top))
    made = ranking.sentence_scores(docs, "doc_id", "text")
    found = {(r.doc_id, r.idx): r.score for r in made.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    short = ranking.summary(docs, "doc_id", "text", 3)
    got = {r.doc_id: r.summary for r in short.collect()}
    assert got.keys() == best.keys()
    ties = [k for k in got if got[k] != best[k][1]]
    assert len(ties) <= len(got) // 100, ties  # sums of doubles may part equal scores whose fractions differ
    queries = [registry.QUERIES[q](spark, SF) for q in ("sentence_scores", "extractive_summary")]
    assert not any("Exchange" in plan_of(q) for q in queries)


def test_vectors_of_any_length_are_compared_by_blocks(spark, monkeypatch):
    """Components that are null or in one vector only don't count, and a vector without any makes no pair: as in the SQL."""
    monkeypatch.setattr(hrr, "ROW_BLOCK", 3)
    monkeypatch.setattr(hrr, "QUERY_BLOCK", 2)
    monkeypatch.setattr(hrr, "TASK_PAIRS", 5)
    vectors = [(0, [0.5, 1.0, 2.0]), (100, [1.5, None, 0.25]), (200, [3.0]), (300, []), (400, None), (500, [None]), (500, [0.1, 0.2]), *[(k, [k / 7, k / 3, 1.0]) for k in range(1, 9)]]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    want = []
    for a, u in vectors:
        for b, v in vectors:
            if a % 100 == 0 and min(len(u or []), len(v or [])):
                both = [np.cos(float(np.float32(x)) - float(np.float32(y))) for x, y in zip(u, v) if x is not None and y is not None]
                want.append((a, b, round(float(np.mean(both)), 5) if both else None))
    found = [(r.a, r.b, r.similarity) for r in hrr.similarities(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding").collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_averages_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Averages that end in a 5 at the seventh place, over many files, are rounded up; no p and no name stand last, NaN after numbers."""
    rng = np.random.default_rng(5)
    cents = {(k // 20, k % 20): [int(x) for x in rng.integers(0, 11, 32)] for k in range(400)}
    for c in cents.values():
        c[0] += (1 - sum(c)) % 2
    rows = [(d, r, x / 100) for (d, r), c in cents.items() for x in c] + [(0, None, 0.5), (0, 20 + 21, None), (50, 1, None), (50, 2, float("nan")), (50, 3, 2.5e-6), (50, 4, -2.5e-6), (50, 5, None), (50, 5, 1e11)]
    order = rng.permutation(len(rows))
    frame = spark.createDataFrame([rows[k] for k in order], "l_suppkey long, l_partkey long, l_discount double")
    frame.repartition(16).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {k: math.floor(Fraction(sum(c) * 10**4, 32) + Fraction(1, 2)) / 1e6 for k, c in cents.items()}
    found = {(r.donor, r.recipient): r for r in registry.QUERIES["p_value_order"](spark, str(tmp_path)).collect()}
    assert {k: found[k].p for k in want} == want
    ranked = sorted((k for k in want if k[0] == 0), key=lambda k: (want[k], k[1]))
    assert [found[k].place for k in ranked] == list(range(1, 21)) and found[0, None].place == 21
    assert [k[1] for k in sorted((k for k in found if k[0] == 50), key=lambda k: found[k].place)] == [4, 3, 5, 2, 1]
    assert [found[50, k].p for k in (4, 3, 5, 1)] == [-3e-6, 3e-6, 1e11, None]


@pytest.mark.parametrize("kind", ["exact", "fuzzy", "token_overlap"])
def test_pairs_of_one_tier_keep_equal_rows_over_slices(spark, monkeypatch, kind):
    """Blocks of four in slices of three and two, taken apart in the JVM: a plain join, equal rows and null ids included."""
    for name, size in (("BLOCK_ROWS", 4), ("LEFT_SLICE", 3), ("RIGHT_SLICE", 2), ("TASK_PAIRS", 100)):
        monkeypatch.setattr(entities, name, size)
    names = ["goat wall river", "river goat wall", "oak", "goat wall lake stone"]
    a = [(k % 13, names[k % 3]) for k in range(30)] + [(None, "oak"), (None, "oak")]
    b = [(k % 7, names[k % 4]) for k in range(25)] + [(None, names[0])]
    left, right = (spark.createDataFrame(x, "row_id long, name string") for x in (a, b))
    made = entities.shared_words(left, right) if kind == "token_overlap" else entities.equal_names(left, right, {"exact": "norm", "fuzzy": "bag"}[kind], kind)
    want = [(x, y, kind) for x, n in a for y, m in b if kind in kinds(normal(n), normal(m))]
    assert sorted(((r.left_row, r.right_row, r.match_type) for r in made.collect()), key=str) == sorted(want, key=str)
    assert "MapInArrow" not in plan_of(made)
