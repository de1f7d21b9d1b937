"""Search, fuzzy ranks, edit scripts and path prefixes against plain versions."""

import difflib
import json
import os.path
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import edits, fuzzy, paths, search

WORDS = ["the", "cat", "sat", "on", "mat", "Über", "deploy", "deployed", "chat", "send", "k8s"]
TOKEN = re.compile(r"[^\W_]+")


def plain(node, words):
    """Positions where each part of an expression holds, the plain way: True or False."""
    if isinstance(node, search.Phrase):
        n = len(node.terms)
        same = lambda a, b, last: a.startswith(b) if last and node.prefix else a == b
        return any(all(same(words[k + j], node.terms[j], j == n - 1) for j in range(n)) for k in range(len(words) - n + 1))
    left, right = plain(node.left, words), plain(node.right, words)
    return (left and right) if isinstance(node, search.Both) else (left or right) if isinstance(node, search.Either) else (left and not right)


P = search.Phrase


@pytest.mark.parametrize(
    "query,want",
    [
        ("docker deployment", search.Both(P(("docker",)), P(("deployment",)))), ('"exact phrase"', P(("exact", "phrase"))), ("a OR b AND c", search.Either(P(("a",)), search.Both(P(("b",)), P(("c",))))),
        ("python NOT java", search.Without(P(("python",)), P(("java",)))), ("deploy*", P(("deploy",), True)), ("(a OR b) c", search.Both(search.Either(P(("a",)), P(("b",))), P(("c",)))),
        ("a NOT b c", search.Without(P(("a",)), search.Both(P(("b",)), P(("c",))))), ('"one tw"*', P(("one", "tw"), True)), ("chat-send", P(("chat", "send"))), ("", None), ("--- OR b", P(("b",))), ("or and not", search.Both(search.Both(P(("or",)), P(("and",))), P(("not",)))),
    ],
)
def test_grammar(query, want):
    assert search.parsed(query) == want


@pytest.mark.parametrize("query", ["(a", "a)", "AND a", "a OR", "NOT a", "a NOT", "()", "*"])
def test_what_cannot_be_parsed_is_an_error(query):
    with pytest.raises(ValueError):
        search.parsed(query)


@pytest.mark.parametrize(
    "typed,query", [("hello AND", "hello"), ("chat-send", '"chat-send"'), ('say "hi', "say hi"), ("a:b {c} ^d", "a b c d"), ("OR x NOT", "x"), ('"kept: phrase" (x)', '"kept: phrase" x'), ("* dep* **", "dep*"), ("a AND OR b", "a AND b"), ("my-app.config*", '"my-app.config"*'), ("- . x", "x")]
)
def test_sanitised(typed, query):
    assert search.sanitised(typed) == query
    search.parsed(search.sanitised(typed))


def test_anything_typed_can_be_parsed_once_sanitised():
    rnd = random.Random(2)
    bits = ['"', "(", ")", "*", "-", "AND", "OR", "NOT", " ", "a", "b-c", "ü", "^", "\0", ".", "_"]
    for _ in range(3000):
        search.parsed(search.sanitised("".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 9)))))


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(1)
    rows = [(k, " ".join(rnd.choice(WORDS) + rnd.choice(["", ",", "-", "."]) for _ in range(rnd.randint(0, 40)))) for k in range(150)] + [(900, None), (901, "")]
    return rows


@pytest.mark.parametrize("query", ["the", "the cat", '"the cat"', "cat OR (mat NOT sat)", "deploy*", '"the dep"*', "über k8s OR send", '"chat send" NOT deployed', "(the OR cat) (sat OR mat) NOT on", "nothing", '"the the" OR "cat cat cat"'])
def test_matches_are_the_plain_ones(spark, texts, tmp_path, query):
    path = str(tmp_path / "index")
    search.write_index(spark.createDataFrame(texts, "id long, content string"), "id", "content", path)
    found = {r.id: [tuple(h) for h in r.hits] for r in search.matches(spark.read.parquet(path), query, "id").collect()}
    node = search.parsed(query)
    assert set(found) == {k for k, t in texts if t and plain(node, TOKEN.findall(t.lower()))}
    assert all(h and h == sorted(h) for h in found.values())


def test_snippets(spark):
    rows = [(1, "The cat, sat on the mat."), (2, "x " * 50 + "the cat, again the cat" + " y" * 50), (3, "cat"), (4, "(the cat cat)")]
    texts = spark.createDataFrame(rows, "id long, content string")
    index = search.positions(texts, "id", "content")
    shown = lambda q: {r.id: r.s for r in texts.join(search.matches(index, q, "id"), "id").select("id", search.snippet(F.col("content"), F.col("hits"), 8).alias("s")).collect()}
    assert shown('"the cat"') == {1: ">>>The cat<<<, sat on the mat.", 2: "...x x >>>the cat<<<, again >>>the cat<<< y...", 4: "(>>>the cat<<< cat)"}
    assert shown("cat NOT mat") == {2: "...x the >>>cat<<<, again the >>>cat<<< y y...", 3: ">>>cat<<<", 4: "(the >>>cat<<< >>>cat<<<)"}


def test_search_with_filters_and_context(spark):
    messages = spark.createDataFrame([(10, 1, 0, "user", 5, "hello there"), (11, 1, 1, "assistant", 6, "an error, sadly"), (12, 1, 4, "user", 7, "b" * 300), (20, 2, 0, "user", 8, "error here")], "id long, session_id long, turn int, role string, ts long, content string")
    sessions = spark.createDataFrame([(1, "cli", "m", 3), (2, "telegram", None, 4)], "id long, source string, model string, started_at long")
    index = search.positions(messages, "id", "content")
    found = lambda **how: [tuple(r) for r in search.search_messages(messages, sessions, index, "error AND", **how).orderBy("id").collect()]
    first = (11, 1, "assistant", 6, "an >>>error<<<, sadly", "hello there", "b" * 200, "cli", "m", 3)
    assert found() == [first, (20, 2, "user", 8, ">>>error<<< here", None, None, "telegram", None, 4)]
    assert found(sources=["cli"]) == found(without_sources=["telegram"]) == found(roles=["assistant"]) == [first]


def plain_score(target, token):
    token, low, at, total = token.lower(), target.lower(), -1, 0.0
    first = None
    for ch in token:
        k = low.find(ch, at + 1)
        if k < 0:
            return None
        total += 1
        if at >= 0:
            total += 5 if k == at + 1 else -min(k - at - 1, 3)
        camel = k > 0 and target[k - 1] == low[k - 1] and target[k] != low[k] and target[k] == target[k].upper()
        if k == 0 or re.match(r"[-_/.\s]", target[k - 1]) or camel:
            total += 3
        total += 5 if k == 0 else 0
        first = k if first is None else first
        at = k
    return total + (8 if token and first == 0 and at == len(token) - 1 else 0) + (20 if low == token else 0) - len(low) * 0.01


def test_fuzzy_ranks_are_the_plain_ones(spark):
    rnd = random.Random(9)
    names = ["gpt-4o", "gptOne", "open/gpt_4", "GPT", "g p t", "", "claude.three", "tpg", "xgxpxt", "gpt"] + ["".join(rnd.choice("gptGPT-_/ o4") for _ in range(rnd.randint(1, 12))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string").repartition(3)
    for query in ("gpt", "g4 p", "o", "GPT gpt", "4o", "zz", ""):
        want = []
        for k, n in enumerate(names):
            points = [plain_score(n, t) for t in query.split()]
            if None not in points:
                total = 0.0
                for p in points:
                    total += p
                want.append((k, total))
        want = [(k, round(v, 6)) for k, v in sorted(want, key=lambda r: (-r[1], r[0]))]
        got = [(r.id, round(r.score, 6)) for r in fuzzy.ranked(rows, "name", query, ["id"]).collect()]
        assert got == want
        assert [(r.id, round(r.score, 6)) for r in fuzzy.ranked(rows, "name", query, ["id"], 7).collect()] == want[:7]


def plain_shift(before, after, line):
    a, b = (before or "").splitlines(), (after or "").splitlines()
    if a == b:
        return line
    for tag, i1, i2, j1, _ in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes():
        if i1 <= line < i2:
            return line - i1 + j1 if tag == "equal" else None
    return len(b) - 1 if b else None


def test_lines_are_remapped(spark, monkeypatch):
    monkeypatch.setattr(edits, "BIN", 4)
    rnd = random.Random(5)
    files = [("same", "a\nb", "a\nb"), ("gone", "a\nb", ""), ("new", None, "x\ny"), ("none", None, None)]
    for k in range(30):
        a = [rnd.choice("abcdef") for _ in range(rnd.randint(0, 40))]
        b = [x for x in a if rnd.random() > 0.2]
        for _ in range(rnd.randint(0, 5)):
            b.insert(rnd.randint(0, len(b)), rnd.choice("xyz"))
        files.append((f"f{k}", "\n".join(a), "\n".join(b)))
    lines = [(n, k, n + "!") for n, a, _ in files for k in range(len((a or "").splitlines()) + 3)] + [("unknown", 7, "u")]
    script = edits.opcodes(spark.createDataFrame(files, "file string, before string, after string"))
    rows = spark.createDataFrame(lines, "file string, line long, tag string").withColumnRenamed("tag", "note")
    known = {n: (a, b) for n, a, b in files}
    got = {(r.file, r.line): r.moved for r in edits.remapped(rows, script).collect()}
    assert got == {(n, k): plain_shift(*known[n], k) if n in known else k for n, k, _ in lines}
    marks = spark.createDataFrame([(n, k, k, k + 2) for n, k, _ in lines], "file string, mark long, start long, stop long")
    want = {(n, k): (s, s if (e := plain_shift(*known[n], k + 2) if n in known else k + 2) is None else e) for n, k, _ in lines if (s := plain_shift(*known[n], k) if n in known else k) is not None}
    assert {(r.file, r.mark): (r.start, r.stop) for r in edits.remapped_ranges(marks, script).collect()} == want


def test_longest_prefix(spark):
    rnd = random.Random(6)
    some = lambda n: "/" + "/".join(rnd.choice("abc") for _ in range(rnd.randint(1, n)))
    roots = sorted({some(4) for _ in range(25)} - {"/a"}) + ["/", "/b//c/"]
    files = [(k, some(7)) for k in range(300)] + [(900, None), (901, "/ab"), (902, "/a/../b/./c"), (903, "rel/x")]
    got = {r.id: r.root for r in paths.longest_prefix(spark.createDataFrame(files, "id long, path string"), "path", spark.createDataFrame([(r,) for r in roots], "root string")).collect()}
    norm = lambda p: os.path.normpath(p)
    for k, p in files:
        fits = [r for r in roots if p and p.startswith("/") and (norm(p) + "/").startswith(norm(r).rstrip("/") + "/")]
        best = max((norm(r) for r in fits), key=len, default=None)
        assert (norm(got[k]) if got[k] else None) == best, (k, p)


def test_parallel_batches(spark):
    call = lambda tool, **args: (tool, json.dumps(args))
    batches = {
        1: ([call("read_file", path="/a/b")], False), 2: ([call("read_file", path="/a/b"), call("read_file", path="/a/bc")], True), 3: ([call("read_file", path="/a"), call("write_file", path="/a/b/c")], False),
        4: ([call("web_search", q="x"), call("web_search", q="x")], True), 5: ([call("web_search"), call("clarify")], False), 6: ([("read_file", "{oops"), call("web_search")], False), 7: ([("web_search", "[1]"), call("web_search")], False),
        8: ([call("read_file"), call("web_search")], False), 9: ([call("terminal"), call("web_search")], False), 10: ([call("patch", path="x/./y"), call("patch", path="x//y")], False), 11: ([call("patch", path="a-b"), call("patch", path="a"), call("patch", path="a.b")], True),
        12: ([call("read_file", path=" "), call("web_search")], False), 13: ([("web_search", None), call("web_search")], False),
    }
    rows = [(b, *c) for b, (calls, _) in batches.items() for c in calls]
    got = {r.batch: r.parallel for r in paths.parallel_batches(spark.createDataFrame(rows, "batch long, tool string, arguments string"), ("clarify",), ("read_file", "write_file", "patch"), ("read_file", "web_search")).collect()}
    assert got == {b: want for b, (_, want) in batches.items()}
