"""Training turns, checks of writes, waits by length, and tables written in versions, against plain versions."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import checks, entities, ranking, trajectories
from sparkloom.sources import writers
from sparkloom.streaming import operators as streams

MESSAGES = "session_id long, turn long, role string, content string, reasoning string, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string"


def test_training_turns(spark):
    calls = [("c1", "terminal", '{"command": "ls \\"x\\""}'), ("c2", "say \"it\"", "not json"), ("c3", "list", "[1]")]
    rows = [
        (1, 0, "tool", "early", None, None, "c0"),
        (1, 1, "user", None, None, None, None),
        (1, 2, "assistant", "", "why\nnot", calls, None),
        (1, 3, "tool", '{"ok": true}', None, None, "c1"),
        (1, 4, "tool", '{"ok": tru', None, None, "c2"),
        (1, 5, "tool", ' [1, "ü\\n"] ', None, None, None),
        (1, 6, "tool", 'four\t"q"', None, None, "c4"),
        (1, 7, "assistant", "<REASONING_SCRATCHPAD>a</REASONING_SCRATCHPAD>b", "  ", [], None),
        (1, 8, "assistant", "plain", None, None, None),
        (2, 0, None, "hi", None, None, None),
        (2, 1, "critic", "no", None, None, None),
    ]
    out = trajectories.training_turns(spark.createDataFrame(rows, MESSAGES)).orderBy("session_id", "place").collect()
    assert [(r.session_id, r["from"]) for r in out] == [(1, "tool"), (1, "human"), (1, "gpt"), (1, "tool"), (1, "gpt"), (1, "gpt"), (2, "human"), (2, "critic")]
    early, empty, called, results, scratch, plain, *_ = [r.value for r in out]
    assert json.loads(early.split("\n")[1]) == {"tool_call_id": "c0", "name": "unknown", "content": "early"} and empty == ""
    assert called.startswith("<think>\nwhy\nnot\n</think>\n<tool_call>\n")
    assert [json.loads(x) for x in called.split("\n") if x.startswith("{")] == [{"name": "terminal", "arguments": {"command": 'ls "x"'}}, {"name": 'say "it"', "arguments": {}}, {"name": "list", "arguments": {}}]
    assert [json.loads(x) for x in results.split("\n") if x.startswith("{")] == [
        {"tool_call_id": "c1", "name": "terminal", "content": {"ok": True}},
        {"tool_call_id": "c2", "name": 'say "it"', "content": '{"ok": tru'},
        {"tool_call_id": "", "name": "list", "content": [1, "ü\n"]},
        {"tool_call_id": "c4", "name": "unknown", "content": 'four\t"q"'},
    ]
    assert scratch == "<think>a</think>b" and plain == "<think>\n</think>\nplain"


def plainly_stale(log):
    """Walks the log, as one process would."""
    stamps, writer, out = {}, {}, {}
    for key, _, task, path, kind, modified, partial in sorted(log, key=lambda r: (r[1], r[0])):
        stamp, last = stamps.get((task, path)), writer.get(path)
        if kind == "write":
            said = None
            if modified is not None and (stamp or last):
                if last and last[0] != task and not stamp:
                    said = "sibling_unread"
                elif last and last[0] != task and last[1] > stamp[0]:
                    said = "sibling"
                elif stamp and stamp[1] != modified:
                    said = "drifted"
                elif stamp and stamp[2]:
                    said = "partial"
            out[key] = said
            writer[path] = (task, (_, key))
        stamps[task, path] = ((_, key), modified, kind == "read" and bool(partial))
    return out


def test_stale_writes(spark):
    draw = random.Random(5)
    log = [(k, draw.randrange(200), draw.randrange(3), f"/p{draw.randrange(4)}", draw.choice(["read", "read", "write"]), draw.choice([1, 1, 1, 2, None]), draw.choice([True, False, None])) for k in range(400)]
    frame = spark.createDataFrame(log, "id long, at long, task long, path string, kind string, modified long, partial boolean")
    want = plainly_stale(log)
    assert {r.id: r.stale for r in checks.stale_writes(frame).collect()} == want and len(set(want.values())) == 5


def test_scoped_rules(spark):
    rules = [checks.Rule("flows", only_path=r"^/ci/"), checks.Rule("py", scope=r"\.py$", substrings=("eval(",), regex=r"exec\s*\("), checks.Rule("any", beyond=r"\.md$", substrings=("eval(",))]
    files = [(1, "/ci/x.py", "eval(1) eval(2) exec (3)"), (2, "/a.md", "eval("), (3, None, "eval("), (4, "/ci/e", ""), (5, "/ci/n", None), (6, "/b.py", "exec  (1)"), (7, "/ci/big.py", "é" * 60 + "eval(")]
    found = checks.scanned(spark.createDataFrame(files, "id long, path string, content string"), rules, most_bytes=100)
    assert sorted((r.id, r.rule) for r in found.collect()) == [(1, "any"), (1, "flows"), (1, "py"), (3, "any"), (6, "py")]


def test_waits_by_length_on_batches_and_streams(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    # Seconds, length: a split text waits 10, a short one 1, others 4.
    said = [(0, 5), (0.5, 5), (1.6, 5), (20, 5000), (29, 30), (40, 30), (43, 5), (45, 30)]
    rows = [(1, start + dt.timedelta(seconds=s), k, "x" * n) for k, (s, n) in enumerate(said)] + [(2, start, 9, None), (3, start + dt.timedelta(hours=1), 10, "late")]
    frame = spark.createDataFrame(rows, "user long, ts timestamp, id long, text string")
    gap = streams.quiet_gap(F.coalesce(F.length("text"), F.lit(0)), 4, ((10, 1), (20, 9)), 4000, 10)
    batch = {(r.user, r.n, r.merged) for r in streams.text_batches(frame, "user", gap).collect()}
    assert sorted(n for u, n, _ in batch if u == 1) == [1, 1, 2, 2, 2] and (2, 1, "") in batch
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    query = streams.text_batches(stream, "user", gap).writeStream.outputMode("append").format("memory").queryName("waits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.user, r.n, r.merged) for r in spark.table("waits").collect()} == {b for b in batch if b[0] != 3}


def test_weights_by_either_join(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(random.Random(k).choices(["apple", "pear", "plum", "fig", "the"], k=k % 9))) for k in range(40)] + [(99, None)], "doc_id long, text string")
    weights = lambda: {(r.doc_id, r.term): round(r.weight, 9) for r in ranking.tfidf(docs, "doc_id", "text").collect()}
    near = weights()
    monkeypatch.setattr(ranking, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(ranking, "HOT_TERM", 3)
    monkeypatch.setattr(ranking, "MOST_HOT", 2)
    assert weights() == near and near
    long = spark.createDataFrame([(1, "pear fig " * 300_000)], "doc_id long, text string")
    assert {r.term: r.weight for r in ranking.tfidf(long, "doc_id", "text").collect()} == {"pear": 1.0, "fig": 1.0}


def test_rows_of_frequent_terms_stay(spark, monkeypatch):
    """Frequent terms' rows meet their frequencies where they are; a search makes weights of rows that hold one of its terms only."""
    docs = spark.createDataFrame([(k, "pear " + " ".join(random.Random(k).choices(["apple", "plum", "fig"], k=k % 5)) + f" only{k}" * 2) for k in range(40)] + [(99, None)], "doc_id long, text string")
    weights = lambda **b: {(r.doc_id, r.term): round(r.weight, 9) for r in ranking.tfidf(docs, "doc_id", "text", **b).collect()}
    near = weights()
    top = lambda **b: ranking.query_topk(ranking.tfidf(docs, "doc_id", "text", **b), ["fig", "none"], 5).collect()
    cosine = lambda: {(r.doc_id, round(r.cosine, 9)) for r in ranking.cosine_to(ranking.tfidf(docs, "doc_id", "text"), 7).collect()}
    best, cosines = top(), cosine()
    for bound in (4, 3, 1, 0):
        monkeypatch.setattr(ranking, "BROADCAST_TERMS", bound)
        assert weights() == near and top() == best == top(holding=["fig", "none"]) and cosine() == cosines and len(best) == 5 and len(cosines) == 39
        held = {k for k, term in near if term == "fig"}
        assert weights(holding=["fig"]) == {(k, term): w for (k, term), w in near.items() if k in held} and weights(holding=[]) == {}
    monkeypatch.setattr(ranking, "BROADCAST_TERMS", 4)
    frame = ranking.tfidf(docs, "doc_id", "text")
    frame.collect()
    assert "LeftAnti" in frame._jdf.queryExecution().executedPlan().toString()


def test_nearest_days(spark):
    draw, day = random.Random(3), lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    events = [(draw.randrange(4), k, None if k % 17 == 0 else day(draw.randrange(300))) for k in range(120)]
    others = [(draw.choice([0, 1, 2, 5]), None if k % 11 == 0 else day(draw.randrange(300))) for k in range(60)]
    want = {e: min(abs((d - o).days) for q, o in others if q == k and o) for k, e, d in events if d and k < 3}
    found = entities.nearest_days(spark.createDataFrame(events, "k long, event_id long, day date"), spark.createDataFrame(others * 3, "k long, day date"), "k")
    assert {r.event_id: r.days for r in found.collect()} == want


def test_batches_of_files_and_their_merger(spark, tmp_path):
    rows = spark.range(0, 103, 1, 7).select(F.col("id").alias("k"), F.concat(F.lit("t"), "id").alias("t"))
    writers.jsonl_batches(rows, str(tmp_path / "b"), 25, ["k"])
    files = sorted((tmp_path / "b").glob("batch=*/*.json"))
    assert [[json.loads(x)["k"] for x in f.read_text().splitlines()] for f in files] == [list(range(s, min(s + 25, 103))) for s in range(0, 103, 25)]
    with pytest.raises(ValueError):
        writers.jsonl_batches(rows.withColumnRenamed("t", "batch"), str(tmp_path / "c"), 5, ["k"])
    parts = {"p10.json": range(5), "p2.json": range(90, 50, -1), "all.json": range(7)}
    for name, keys in parts.items():
        (tmp_path / name).write_text("".join(json.dumps({"k": k}) + "\n" for k in keys))
    assert [r.k for r in writers.merged(spark, [str(tmp_path / n) for n in parts], "all.json").collect()] == [*range(5), *range(90, 50, -1)]


def test_a_table_is_replaced_at_once(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        writers.current(spark, path)
    for n in (3, 5):
        writers.replaced(spark.range(n), path)
    begun = writers.current(spark, path)
    writers.replaced(begun.where("id > 1"), path)
    assert begun.count() == 5 and sorted(r.id for r in writers.current(spark, path).collect()) == [2, 3, 4]
    with pytest.raises(Exception):
        writers.replaced(spark.range(3).select(F.raise_error(F.lit("stop")).alias("id")), path)
    assert writers.current(spark, path).count() == 3
    writers.replaced(spark.range(1), path)
    assert sum(p.name.startswith("v-") for p in (tmp_path / "t").iterdir()) == 2
