"""Incremental totals, holographic facts, sources of parts of files, numbers in order."""

import hashlib
import math
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import hrr, numbering
from sparkloom.operators import sessions as ops
from sparkloom.sources import pieces, readers
from sparkloom.streaming import incremental

ROWS = "entity long, `group` string, amount double"


def recomputed(batches):
    now = {}
    for rows in batches:
        for e in {r[0] for r in rows}:
            now[e] = [(g, a or 0.0) for x, g, a in rows if x == e and g is not None]
    out = {}
    for given in now.values():
        for g, a in given:
            n, total = out.get(g, (0, 0.0))
            out[g] = (n + 1, round(total + a, 6))
    return out


def test_totals_are_those_of_a_full_recompute(spark, tmp_path):
    rnd = random.Random(1)
    batches = [[(rnd.randrange(12), rnd.choice("abc"), float(rnd.randint(0, 9))) for _ in range(40)] for _ in range(4)]
    batches[1].append((99, None, None))
    batches[2] = [(0, None, None), (1, "z", None)]
    folder = str(tmp_path / "t")
    got = lambda: {r.group: (r.n, round(r.total, 6)) for r in incremental.totals(spark, folder).collect()}
    assert got() == {}
    for k, rows in enumerate(batches):
        incremental.apply_batch(spark.createDataFrame(rows, ROWS), k, folder)
        assert got() == recomputed(batches[: k + 1])
        incremental.apply_batch(spark.createDataFrame(rows, ROWS), k, folder)  # run again
        assert got() == recomputed(batches[: k + 1])
    other = [(3, "q", 1.0)]
    incremental.apply_batch(spark.createDataFrame(other, ROWS), 3, folder)  # run again with other rows
    assert got() == recomputed([*batches[:3], other])


def test_totals_of_a_stream(spark, tmp_path):
    batches = [[(1, "a", 1.0), (2, "a", 2.0)], [(1, "b", 5.0)], [(2, None, None), (3, "a", 7.0)]]
    source, folder = str(tmp_path / "in"), str(tmp_path / "t")
    for rows in batches:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(source)
        incremental.maintained(spark.readStream.schema(ROWS).parquet(source), folder, str(tmp_path / "c")).awaitTermination()
    assert {r.group: (r.n, r.total) for r in incremental.totals(spark, folder).collect()} == {"b": (1, 5.0), "a": (1, 7.0)}


def plain_atom(word, dim):
    values = []
    for k in range(math.ceil(dim / 16)):
        values += struct.unpack("<16H", hashlib.sha256(f"{word}:{k}".encode()).digest())
    return np.array(values[:dim]) * 2 * math.pi / 65536


def test_facts_and_what_is_asked_of_them(spark):
    assert np.allclose(hrr.atom("word", 40), plain_atom("word", 40))
    rows = [(k, f"fact number {k} about the {w}", [w.upper(), "all"]) for k, w in enumerate(["cat", "dog", "sky", "sea"] * 3)] + [(100, "cats fly over hills", ["cat"]), (200, None, None)]
    facts = hrr.encoded(spark.createDataFrame(rows, "id long, content string, entities array<string>"), 512).cache()
    found = {r.id: np.array(r.vector) for r in facts.collect()}
    parts = [hrr.text_vector(rows[1][1], 512) + plain_atom("__hrr_role_content__", 512)] + [plain_atom(e, 512) + plain_atom("__hrr_role_entity__", 512) for e in ("dog", "all")]
    want = np.angle(sum(np.exp(1j * p) for p in parts)) % (2 * math.pi)
    assert np.allclose(np.cos(found[1] - want), 1)
    assert {r.id for r in hrr.probe(facts, "Dog", 3, 512).collect()} == {1, 5, 9}
    odd = {(r.id, r.other) for r in hrr.contradictions(facts, 0.5, 512).collect()}
    assert odd == {(0, k) for k in ()} | {p for p in odd if p[0] in (0, 100)} and {(100, 0), (100, 4), (100, 8), (0, 100)} <= odd
    two = spark.range(1).select(F.lit([1.0, 6.0]).alias("a"), F.lit([2.0, 3.0]).alias("b"))
    r = two.select(hrr.bind("a", "b").alias("x"), hrr.unbind(hrr.bind("a", "b"), F.col("b")).alias("y"), hrr.similarity(F.col("a"), F.col("a")).alias("s")).first()
    assert np.allclose(r.x, [3.0, 9.0 - 2 * math.pi]) and np.allclose(r.y, [1.0, 6.0]) and r.s == 1.0
    bank = {r.kind: r for r in hrr.banks(facts.withColumn("kind", F.col("id") % 2), "kind", 512).collect()}
    want = np.angle(sum(np.exp(1j * v) for k, v in found.items() if k % 2)) % (2 * math.pi)
    assert np.allclose(np.cos(np.array(bank[1].vector) - want), 1) and bank[1].n == 6 and math.isclose(bank[1].snr, math.sqrt(512 / 6))
    facts.unpersist()


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_last_lines_are_read_from_the_end(spark, tmp_path, block):
    files = {"a.log": "one\ntwo\nthree\n", "b.log": "x\n\ny", "c.log": "", "d.log": "\n\n", "e.log": "".join(f"line {k}\r\n" for k in range(500))}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body.encode())
    found = {}
    for r in pieces.tail(spark, [str(tmp_path / n) for n in files], 2, block).collect():
        found.setdefault(r.path.rsplit("/", 1)[1], []).append((r.from_end, r.value))
    want = {n: [(len(t) - k, v) for k, v in enumerate(t)] for n, b in files.items() if (t := b.replace("\r", "").removesuffix("\n").split("\n")[-2:] if b else [])}
    assert found == want


def test_the_head_of_a_log_is_not_read(tmp_path):
    path = tmp_path / "big.log"
    path.write_bytes(b"x" * 5_000_000 + b"\nlast but one\nlast\n")
    with pieces.opened(str(path)) as file:
        assert pieces.last_lines(file, 2, 100) == [b"last but one", b"last"]
        assert file.tell() >= 4_999_000


def test_members_of_archives(spark, tmp_path):
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            z.writestr("people.csv", "﻿name,place\n" + "".join(f"n{k}-{j},{'Rome' if j % 2 else 'Paris'}\n" for j in range(50)))
            z.writestr("notes.txt", "no table")
    files = [str(tmp_path / f"{k}.zip") for k in range(2)]
    rows = pieces.zip_csv(spark, files, ["name", "absent"], holds="rome", limit=3)
    assert sorted((r.name, r.absent) for r in rows.collect()) == [(f"n{k}-{j}", None) for k in range(2) for j in (1, 3, 5)]
    assert pieces.zip_csv(spark, files, ["name"]).count() == 100


def test_ordinals_over_several_splits(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 700)):
        (tmp_path / f"{name}.csv").write_text("key,value\n" + "".join(f"{name}{k},{'v' * (k % 40)}\n" for k in range(n)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = readers.csv(spark, str(tmp_path), ["key"], "row")
        found = [(r.key, r.row) for r in rows.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(found) == 3700 and all(int(k[1:]) == row for k, row in found)


def test_numbers_in_order(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", "hot", "x", None]), k) for k in rnd.sample(range(5000), 900)]
    got = {(r.g, r.k): r.n for r in numbering.numbered(spark.createDataFrame(rows, "g string, k long").repartition(5), "g", ["k"], "n").collect()}
    want = {}
    for g in {g for g, _ in rows}:
        want |= {(g, k): n for n, k in enumerate(sorted(k for x, k in rows if x == g), 1)}
    assert got == want


def test_tail_keeps_calls_and_results_together(spark):
    rows = [(1, 0, "user", 50), (1, 1, "assistant", 10), (1, 2, "tool", 30), (1, 3, "tool", 30), (1, 4, "user", 5), (2, 0, "assistant", 1), (2, 1, "tool", 900)]
    m = spark.createDataFrame(rows, "session_id long, turn long, role string, size long")
    kept = lambda budget: {(r.session_id, r.turn) for r in ops.tail_groups_within(m, budget, F.col("size")).collect()}
    assert kept(74) == {(1, 4), (2, 0), (2, 1)}
    assert kept(75) == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 0), (2, 1)}
