"""Plans of search, fuzzy ranks, edit scripts, path prefixes, scrubbed streams and exact copies."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..operators import edits, fuzzy, hrr, paths, search, sessions, stages
from ..streaming import incremental, stateful
from .base import query

TOKENS = "regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')"
#: Queries that cover the grammar, and what they ask of the tokens (list tk, string s with a space on either side).
ASKED = (
    ("the it", "list_contains(tk, 'the') AND list_contains(tk, 'it')"),
    ('"of the"', "s LIKE '% of the %'"),
    ("the OR la AND is", "list_contains(tk, 'the') OR (list_contains(tk, 'la') AND list_contains(tk, 'is'))"),
    ("(the OR la) NOT of", "(list_contains(tk, 'the') OR list_contains(tk, 'la')) AND NOT list_contains(tk, 'of')"),
    ("than*", "s LIKE '% than%'"),
    ('"to the th"* OR on', "s LIKE '% to the th%' OR list_contains(tk, 'on')"),
    ("the NOT of on", "list_contains(tk, 'the') AND NOT (list_contains(tk, 'of') AND list_contains(tk, 'on'))"),
)


@query(f"SELECT term, id, count(*) AS n FROM (SELECT id, unnest({TOKENS}) AS term FROM v_messages) GROUP BY term, id")
def fts_index(t):
    return search.positions(t.v_messages, "id", "content").select("term", "id", F.size("positions").cast("long").alias("n"))


@query(f"WITH b AS (SELECT id, tk, concat(' ', array_to_string(tk, ' '), ' ') AS s FROM (SELECT id, {TOKENS} AS tk FROM v_messages)) " + " UNION ALL ".join("SELECT '" + q.replace("'", "''") + f"' AS asked, id FROM b WHERE {sql}" for q, sql in ASKED))
def fts_grammar(t):
    """Each query of a stated set over the index of all messages."""
    index = search.positions(t.v_messages, "id", "content")
    return reduce(lambda a, b: a.unionByName(b), [search.matches(index, q, "id").select(F.lit(q).alias("asked"), "id") for q, _ in ASKED])


@query(f"""SELECT m.id, m.session_id, role, len(list_filter(tk, lambda x: x = 'the')) AS hits, before, after, source FROM (SELECT *, {TOKENS} AS tk, lag(substring(content, 1, 200)) OVER w AS before, lead(substring(content, 1, 200)) OVER w AS after
FROM v_messages WINDOW w AS (PARTITION BY session_id ORDER BY turn)) m JOIN v_sessions s ON s.id = m.session_id WHERE list_contains(tk, 'the') AND NOT list_contains(tk, 'it') AND source <> 'telegram' AND role IN ('user', 'assistant')""")
def fts_search(t):
    """A search with filters, the marks of its snippets counted in the whole text, and the messages around."""
    index = search.positions(t.v_messages, "id", "content")
    found = search.search_messages(t.v_messages, t.v_sessions, index, "the NOT it AND", without_sources=["telegram"], roles=["user", "assistant"])
    counted = search.matches(index, "the NOT it", "id").select("id", F.size("hits").cast("long").alias("hits"))
    return found.join(counted, "id").select("id", "session_id", "role", "hits", "before", "after", "source")


@query()
def fuzzy_rank(t):
    """Names of parts by a typed query; the best are kept by each task."""
    return fuzzy.ranked(t.part.select("p_partkey", "p_name"), "p_name", "s gi", ["p_partkey"], 50).select("p_partkey", "p_name", F.round("score", 6).alias("score"))


DEEP = "concat('/', source, '/d', CAST(doc_id % 10 AS STRING), '/e', CAST(doc_id % 7 AS STRING), '/', CAST(doc_id AS STRING), '.txt')"
ROOTS = "SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN concat('/', source) WHEN doc_id % 3 = 1 THEN concat('/', source, '/d', CAST(doc_id % 5 AS STRING)) ELSE concat('/', source, '/d', CAST(doc_id % 4 AS STRING), '/e', CAST(doc_id % 3 AS STRING)) END AS root FROM documents WHERE doc_id % 20 < 9"


@query(f"SELECT f.doc_id, arg_max(root, length(root)) AS project FROM (SELECT doc_id, {DEEP} AS path FROM documents) f LEFT JOIN ({ROOTS}) r ON starts_with(f.path, concat(r.root, '/')) GROUP BY f.doc_id")
def file_project(t):
    """The project of each file: of the roots that hold it, the nearest."""
    roots = t.documents.where("doc_id % 20 < 9").select(F.expr(ROOTS.split("DISTINCT ")[1].split(" AS root FROM")[0]).alias("root")).distinct()
    return paths.longest_prefix(t.documents.select("doc_id", F.expr(DEEP).alias("path")), "path", roots).select("doc_id", F.col("root").alias("project"))


ARGUMENTS = """CASE tool_name WHEN 'read_file' THEN concat('{"path": "/s/', CAST(session_id % 2 AS STRING), CASE WHEN turn % 3 = 0 THEN '' ELSE concat('/', CAST(turn % 4 AS STRING)) END, '"}') WHEN 'terminal' THEN '{}' ELSE CASE WHEN id % 11 = 0 THEN '{"q": ' ELSE '{"q": "x"}' END END"""


@query(f"""WITH c AS (SELECT id, session_id, tool_name, {ARGUMENTS} AS args FROM v_messages WHERE tool_name IS NOT NULL), p AS (SELECT id, session_id, concat(json_extract_string(args, '$.path'), '/') AS path FROM c WHERE tool_name = 'read_file'),
o AS (SELECT DISTINCT a.session_id FROM p a JOIN p b ON a.session_id = b.session_id AND a.id < b.id AND (starts_with(a.path, b.path) OR starts_with(b.path, a.path)))
SELECT session_id AS batch, count(*) > 1 AND bool_and(tool_name <> 'terminal' AND json_valid(args)) AND session_id NOT IN (SELECT session_id FROM o) AS parallel FROM c GROUP BY session_id""")
def parallel_batches(t):
    """Whether the calls of a batch may run at once: none exclusive or with odd arguments, no path in another's."""
    calls = t.v_messages.where("tool_name IS NOT NULL").select(F.col("session_id").alias("batch"), F.col("tool_name").alias("tool"), F.expr(ARGUMENTS).alias("arguments"))
    return paths.parallel_batches(calls, ("terminal",), ("read_file",), ("web_search",))


@query()
def edited_lines(t):
    """Lines of every text through an edit that drops some sentences and adds one: how many stay, and where they go."""
    before = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n"))
    after = F.concat(F.regexp_replace(before, r"(?m)^[A-D][^\n]*\n", ""), F.lit("\nadded"))
    files = t.documents.select(F.col("doc_id").cast("string").alias("file"), before.alias("before"), after.alias("after"))
    lines = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.size(F.split("before", "\n")).cast("long") + 1)).alias("line"))
    moved = edits.remapped(lines, edits.opcodes(files))
    return moved.groupBy(F.col("file").cast("long").alias("doc_id")).agg(F.count("*").alias("lines"), F.count("moved").alias("kept"), F.sum("moved").alias("moved"))


@query("SELECT id, regexp_replace(marked, '<think>[^<]*</think>', '', 'g') AS shown FROM v_messages WHERE regexp_replace(marked, '<think>[^<]*</think>', '', 'g') <> ''")
def scrubbed_deltas(t):
    """Messages that arrive in pieces of seven characters, without the thoughts in them; as on the stream."""
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("marked") - 1), F.lit(7))
    pieces = t.v_messages.select(F.col("id").alias("key"), "marked", F.explode(cuts).alias("at"))
    pieces = pieces.select("key", F.col("at").alias("seq"), F.substr("marked", F.col("at") + 1, F.lit(7)).alias("piece"), (F.col("at") + 7 >= F.length("marked")).alias("last"))
    shown = stateful.scrub(pieces).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "visible"))).alias("parts"))
    return shown.select(F.col("key").cast("long").alias("id"), F.array_join(F.transform("parts", lambda p: p["visible"]), "").alias("shown"))


@query()
def paced_requests(t):
    """Requests, reports of work and refusals of each user, through a bucket that refills."""
    kind = F.when(F.col("event_id") % 11 == 0, "refused").when(F.col("event_id") % 5 == 0, "report").otherwise("request")
    rows = t.events.select(F.col("user_id").alias("key"), "event_id", "ts", kind.alias("kind"), (F.col("event_id") % 3 + 1).alias("n"))
    return stateful.pace(rows, 5.0, 1 / 3600).select("event_id", "passed", F.round("wait_s", 3).alias("wait_s"))


@query("SELECT doc_id, min(doc_id) OVER w AS class_id, count(*) OVER w AS copies, count(*) OVER w - 1 AS links FROM documents WINDOW w AS (PARTITION BY coalesce(md5(text), ''))")
def exact_copies(t):
    """Each document's class of equal texts by its digest: the least of them, their number, and its links to others."""
    rows = t.documents.select("doc_id", F.coalesce(F.md5("text"), F.lit("")).alias("digest"))
    classes = rows.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    return rows.join(classes, "digest").select("doc_id", "class_id", "copies", (F.col("copies") - 1).alias("links"))


@query("SELECT event_type AS \"group\", count(*) AS n, round(sum(CASE WHEN event_id % 3 = 0 THEN value * 2 ELSE value END), 4) AS total FROM events WHERE user_id % 7 <> 0 OR event_id % 3 <> 1 GROUP BY 1")
def incremental_totals(t):
    """Totals by batches: all users once, some of them again with other amounts and fewer events, one batch twice."""
    spark, folder = t.events.sparkSession, f"{stages.shared_dir(t.events.sparkSession)}/totals-{uuid.uuid4().hex}"
    given = lambda rows, amount: rows.select(F.col("user_id").alias("entity"), F.col("event_type").alias("group"), amount.alias("amount"))
    doubled = F.when(F.col("event_id") % 3 == 0, F.col("value") * 2).otherwise(F.col("value"))
    incremental.apply_batch(given(t.events, F.col("value")), 0, folder)
    incremental.apply_batch(given(t.events.where("user_id % 7 != 0"), doubled), 1, folder)
    for _ in range(2):
        incremental.apply_batch(given(t.events.where("user_id % 7 = 0 and event_id % 3 != 1"), doubled), 2, folder)
    return incremental.totals(spark, folder).select("group", "n", F.round("total", 4).alias("total"))


ROLED = "CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN 'tool' ELSE role END"


@query(f"""WITH m AS (SELECT id, session_id, turn, {ROLED} AS role, length(content) // 4 + CASE WHEN id % 9 = 0 THEN 1600 ELSE 0 END AS tokens FROM v_messages), g AS (SELECT *, sum(CASE WHEN role <> 'tool' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn) AS grp FROM m),
s AS (SELECT session_id, grp, sum(tokens) AS size FROM g GROUP BY 1, 2), c AS (SELECT session_id, grp, sum(size) OVER (PARTITION BY session_id ORDER BY grp DESC) AS upto, max(grp) OVER (PARTITION BY session_id) AS last FROM s)
SELECT g.id FROM g JOIN c ON g.session_id = c.session_id AND g.grp = c.grp WHERE upto <= 400 OR g.grp = last""")
def tail_groups_cut(t):
    """The tail of each session within a budget; an image costs a fixed charge, and no call is parted from its results."""
    rows = t.v_messages.withColumn("role", F.expr(ROLED))
    tokens = F.floor(F.length("content") / 4) + F.when(F.col("id") % 9 == 0, 1600).otherwise(0)
    return sessions.tail_groups_within(rows, 400, tokens).select("id")


@query()
def hrr_probe(t):
    """Facts of documents and the entities they name, asked for one of them."""
    facts = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("content"), F.array(F.concat(F.lit("item"), (F.col("item_id") % 7).cast("string"))).alias("entities"))
    return hrr.probe(hrr.encoded(facts), "item3", 10).select("id", F.round("score", 6).alias("score"))


@query()
def hrr_banks(t):
    facts = t.benchmark.select((F.col("item_id") % 5).alias("bank"), F.col("text").alias("content"), F.array().cast("array<string>").alias("entities"))
    return hrr.banks(hrr.encoded(facts, 256), "bank", 256).select("bank", "n", F.round("snr", 6).alias("snr"), F.round(F.element_at("vector", 1), 5).alias("first"))
