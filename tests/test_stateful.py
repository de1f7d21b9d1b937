"""Scrubbers and pacers: every way to cut a text, streams against batches, chains of parents."""

import random

import pandas as pd
import pytest

from sparkloom.operators import lineage
from sparkloom.streaming import stateful as st

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def driven(scrubber, pieces):
    state, out = scrubber.START, []
    for p in pieces:
        state, shown = scrubber(state, p)
        out.append(shown)
    return "".join(out) + scrubber(state, "", True)[1]


THOUGHTS = [
    ("<think>reasoning</think>Hello world", "Hello world"), ("Hello <think>note</think> world", "Hello  world"), ("<THINK>x</Think>Hello", "Hello"), ("<think>reasoning text with no close", ""),
    ("Hello\n<think>reasoning", "Hello\n"), ("Hello\n  <think>reasoning", "Hello\n  "), ("Use the <think> element for reasoning", "Use the <think> element for reasoning"), ("Hello</think> world", "Helloworld"),
    ("A</think>B</thinking>C", "ABC"), ("word<think>prose</think>more", "wordmore"), ("word<", "word<"), ("<think>a</think><think>b</think>\n\nshow", "\n\nshow"), ("a < b <thin k></x>", "a < b <thin k></x>"),
    ("<REASONING_SCRATCHPAD>x</REASONING_SCRATCHPAD>Hello", "Hello"), ("", ""), ("<think>un<think>even</think>x</think>  y", "xy"),
]
SPANS = [
    ("<memory-context>\n[note]\n\n## stale\n</memory-context>\n\nVisible answer", "\n\nVisible answer"), ("Hello\n<memory-context>\npayload more\n</memory-context> world", "Hello\n world"), ("hello <memory other", "hello <memory other"),
    ("In that `<memory-context>` block, none.", "In that `<memory-context>` block, none."), ("Intro\n<memory-context> is the tag name.", "Intro\n<memory-context> is the tag name."), ("pre \n<memory-context>\nsecret never closed", "pre \n"),
    ("<MEMORY-CONTEXT>\nsecret</Memory-Context>visible", "visible"), ("x\n<memory-context>", "x\n<memory-context>"),
]
CONTEXT = st.Scrubber(st.CONTEXT_TAGS, pairs=False, orphans=False, newline=True)


@pytest.mark.parametrize("scrubber,text,want", [(st.Scrubber(), *x) for x in THOUGHTS] + [(CONTEXT, *x) for x in SPANS])
def test_every_way_to_cut_a_text(scrubber, text, want):
    assert driven(scrubber, [text]) == want
    assert driven(scrubber, list(text)) == want
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1, 3):
            assert driven(scrubber, [text[:a], text[a:b], text[b:]]) == want


def test_random_texts_do_not_depend_on_cuts():
    rnd = random.Random(3)
    bits = ["<think>", "</think>", "<thin", "<", "/", "\n", " ", "ab", "<memory-context>", "</memory-context>", "think>", "c" * 12]
    for _ in range(600):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        for scrubber in (st.Scrubber(hold=10), st.Scrubber(hold=0), CONTEXT):
            want = driven(scrubber, [text])
            cuts = sorted(rnd.randint(0, len(text)) for _ in range(rnd.randint(0, 5)))
            assert driven(scrubber, [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]) == want
            assert driven(scrubber, list(text)) == want


def test_no_more_than_the_hold_is_held():
    scrubber = st.Scrubber(hold=100)
    state, shown = scrubber(scrubber.START, "see <think> " + "x" * 1000)
    assert len(state[0]) <= 100 + 30 and shown.startswith("see <think> ")
    state, _ = scrubber(scrubber.START, "<think>" + "x" * 100_000)
    assert state[0] == ""


def pieces_of(texts, size):
    rnd = random.Random(size)
    rows = []
    for key, text in texts:
        at, seq = 0, 0
        while at < len(text):
            n = rnd.randint(1, size)
            rows.append((key, seq, text[at : at + n], at + n >= len(text)))
            at, seq = at + n, seq + 1
    return rows


def test_scrubbed_stream_is_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    texts = [(f"k{k}", t) for k, (t, _) in enumerate(THOUGHTS * 3) if t]
    rows = pieces_of(texts, 5)
    schema = "key string, seq long, piece string, last boolean"
    folder = str(tmp_path / "in")
    for part in range(3):  # three batches of the stream, each key's pieces in order
        spark.createDataFrame([r for r in rows if min(r[1] // 2, 2) == part] or rows[:0], schema).coalesce(1).write.mode("append").parquet(folder)
    whole = lambda found: {k: "".join(v for _, v in sorted(vs)) for k, vs in found.items()}

    def gathered(df):
        out = {}
        for r in df.collect():
            out.setdefault(r.key, []).append((r.seq, r.visible))
        return whole(out)

    batch = gathered(st.scrub(spark.read.schema(schema).parquet(folder)))
    assert batch == {k: w for (k, _), w in zip([(f"k{k}", t) for k, (t, _) in enumerate(THOUGHTS * 3)], [w for _, w in THOUGHTS * 3], strict=True) if w}
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = st.scrub(source).writeStream.outputMode("append").format("memory").queryName("scrubbed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert gathered(spark.table("scrubbed")) == batch


def test_quiet_keys_are_flushed(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema, folder = "key string, seq long, piece string, last boolean", str(tmp_path / "in")
    spark.createDataFrame([("a", 0, "word<", None), ("b", 0, "see <think> it", None), (None, 0, "x", None)], schema).coalesce(1).write.parquet(folder)
    source = spark.readStream.schema(schema).parquet(folder)
    query = st.scrub(source, quiet_ms=200).writeStream.outputMode("append").format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            found = {}
            for r in sorted(spark.table("quiet").collect(), key=lambda r: r.key):
                found[r.key] = found.get(r.key, 0) + len(r.visible)
            if found == {"a": 5, "b": 14}:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert found == {"a": 5, "b": 14}


def paced(rows, capacity, rate):
    """The bucket as plain sums."""
    out, state = {}, {}
    for key, event, ts, kind, n in sorted(rows, key=lambda r: (r[2], r[1])):
        tokens, since = state.get(key, (capacity, ts))
        if kind != "report":
            tokens = min(capacity, tokens + (ts - since).total_seconds() * rate)
        if kind == "request":
            out[event] = (tokens >= n, max(0.0, (n - tokens) / rate))
            tokens -= n if tokens >= n else 0
        elif kind == "report":
            tokens = max(0.0, tokens - n)
        else:
            tokens = 0.0
        state[key] = (tokens, ts)
    return out


def test_paced_stream_is_the_batch_and_the_plain_one(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rnd, base = random.Random(4), pd.Timestamp("2024-01-01")
    rows = [(f"u{rnd.randrange(4)}", k, base + pd.Timedelta(seconds=k * 3 + rnd.randrange(3)), rnd.choice(["request"] * 6 + ["report", "refused"]), float(rnd.randint(1, 3))) for k in range(300)]
    want = paced(rows, 5.0, 0.3)
    schema, folder = "key string, event_id long, ts timestamp, kind string, n double", str(tmp_path / "in")
    for a in range(0, 300, 100):
        spark.createDataFrame(pd.DataFrame(rows[a : a + 100], columns=["key", "event_id", "ts", "kind", "n"]), schema).coalesce(1).write.mode("append").parquet(folder)
    got = {r.event_id: (r.passed, r.wait_s) for r in st.pace(spark.read.parquet(folder), 5.0, 0.3).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = st.pace(source, 5.0, 0.3).writeStream.outputMode("append").format("memory").queryName("paced").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.event_id: r.passed for r in spark.table("paced").collect()} == {k: v[0] for k, v in want.items()}


def test_follow_filters_lines(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("2024-01-01 00:00:01 INFO agent.loop started\n2024-01-01 00:00:02 ERROR agent.loop failed\n2024-01-01 00:00:03 ERROR gateway down\nno level here\n")
    query = st.follow(spark, str(folder), "WARNING", "agent").writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.line for r in spark.table("followed").collect()] == ["2024-01-01 00:00:02 ERROR agent.loop failed"]


def test_chains_and_circles(spark):
    links = [(k, k - 1 if k % 50 else None) for k in range(200)] + [(300, 301), (301, 302), (302, 300), (303, 300), (400, 999), (401, 401), (None, 3), (402, None), (402, None)]
    got = {r.id: (r.end, r.hops, r.circular) for r in lineage.ends(spark.createDataFrame(links, "id long, next long")).collect()}
    want = {k: (k - k % 50, k % 50, False) for k in range(200)} | {k: (None, None, True) for k in (300, 301, 302, 303, 401)} | {400: (400, 0, False), 402: (402, 0, False)}
    assert got == want
    assert lineage.ends(spark.createDataFrame([], "id long, next long")).count() == 0


def test_resume_follows_the_newest_child(spark):
    rows = [("head", None, 0), ("mid1", "head", 1), ("mid2", "mid1", 2), ("bulk", "mid2", 3), ("tail", "bulk", 4), ("root", None, 0), ("child", "root", 1), ("old", "fork", 1), ("new", "fork", 2), ("fork", None, 0), ("alone", None, 9), ("r", "s", 1), ("s", "r", 2)]
    sessions = spark.createDataFrame(rows, "id string, parent_session_id string, started_at long")
    spoken = spark.createDataFrame([("bulk",), ("root",), ("old",), ("new",), ("bulk",)], "id string")
    got = {r.id: r.target for r in lineage.resume_targets(sessions, spoken).collect()}
    assert got == {"head": "bulk", "mid1": "bulk", "mid2": "bulk", "bulk": "bulk", "tail": "tail", "root": "root", "child": "child", "fork": "new", "old": "old", "new": "new", "alone": "alone", "r": "r", "s": "s"}
    assert {r.id: r.root for r in lineage.roots(sessions).collect()}["tail"] == "head"
