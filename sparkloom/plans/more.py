"""Further plans: predicates on tool results, fallback joins, rankings within groups, block and remark parsing, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..operators import numbering
from .base import query

# Derived columns are written once, in SQL that Spark and DuckDB read alike.
RESULT = """CASE id % 4 WHEN 0 THEN concat('{"bytes_written": ', CAST(size AS STRING), '}') WHEN 1 THEN '{"success": true}' WHEN 2 THEN '{"success": true, "error": "disk  full"}' ELSE 'wrote it' END"""
ARGS = """CASE id % 3 WHEN 0 THEN concat('{"path": "f', CAST(turn AS STRING), '.py", "n": 1}') WHEN 1 THEN '{"path": broken' ELSE '{"n": 2}' END"""
SINCE = "CASE id % 6 WHEN 0 THEN '30m' WHEN 1 THEN '2 h' WHEN 2 THEN '7d' WHEN 3 THEN '45s' WHEN 4 THEN 'soon' ELSE '5 weeks' END"
REMARK = "concat('DOB ', CAST(1950 + id % 40 AS STRING), '; POB Town ', CAST(id % 9 AS STRING), CASE WHEN id % 4 = 0 THEN '; Passport P' || CAST(id AS STRING) ELSE '' END)"


@query("SELECT id FROM v_messages WHERE role = 'assistant' AND tool_name = 'terminal'")
def evidence_equal(t):
    return t.v_messages.where((F.col("role") == "assistant") & (F.col("tool_name") == "terminal")).select("id")


@query("SELECT session_id FROM v_messages GROUP BY session_id HAVING count(*) FILTER (WHERE tool_name NOT IN ('read_file', 'terminal')) = 0")
def invalid_tool_discard(t):
    """Sessions all of whose tools are known stay."""
    unknown = ~F.col("tool_name").isin("read_file", "terminal")
    return t.v_messages.groupBy("session_id").agg(F.count_if(unknown).alias("n")).where("n = 0").select("session_id")


@query(f"""SELECT id, CASE WHEN json_valid(r) THEN (json_extract_string(r, '$.bytes_written') IS NOT NULL OR coalesce(json_extract_string(r, '$.success') = 'true', false)) AND json_extract_string(r, '$.error') IS NULL ELSE false END AS landed
FROM (SELECT id, {RESULT} AS r FROM v_files)""")
def write_landed(t):
    """A result that names bytes or success, and no error."""
    at = lambda key: F.get_json_object("r", f"$.{key}")
    landed = (at("bytes_written").isNotNull() | F.coalesce(at("success") == "true", F.lit(False))) & at("error").isNull()
    return t.v_files.select("id", F.expr(RESULT).alias("r")).select("id", landed.alias("landed"))


PRICES = "CASE model WHEN 'alpha' THEN 25.0 WHEN 'beta' THEN 3.0 END AS input_price, CASE model WHEN 'alpha' THEN 75.0 WHEN 'beta' THEN 120.0 END AS output_price"


@query(f"SELECT id, coalesce(input_price > 20, false) OR coalesce(output_price > 100, false) AS warned FROM (SELECT id, {PRICES} FROM v_sessions WHERE id % 5 <> 1)")
def cost_guard(t):
    """Dollars a million tokens above which a model is warned of; unknown prices are no reason."""
    dear = lambda price, most: F.coalesce(F.col(price) > most, F.lit(False))
    return t.v_sessions.where("id % 5 <> 1").selectExpr("id", *PRICES.split(", ")).select("id", (dear("input_price", 20) | dear("output_price", 100)).alias("warned"))


@query("SELECT id, list_contains([id % 3, id % 5, id % 7], 0) AS exhausted FROM v_sessions")
def limits_exhausted(t):
    """A rate limit is exhausted if any of its buckets has nothing left."""
    return t.v_sessions.select("id", F.exists(F.array(F.col("id") % 3, F.col("id") % 5, F.col("id") % 7), lambda left: left == 0).alias("exhausted"))


@query("""SELECT s_suppkey AS vendor, coalesce(a.c_custkey, b.c_nationkey, d.ps) AS matched, CASE WHEN a.c_custkey IS NOT NULL THEN 'donor' WHEN b.c_nationkey IS NOT NULL THEN 'recipient' WHEN d.ps IS NOT NULL THEN 'linked' END AS by_way FROM supplier
LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) a ON a.c_custkey = s_suppkey LEFT JOIN (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey % 2 = 0) b ON b.c_nationkey = s_suppkey
LEFT JOIN (SELECT l_suppkey, min(l_partkey) AS ps FROM lineitem GROUP BY 1) d ON d.l_suppkey = s_suppkey""")
def fallback_joins(t):
    """A vendor as donor, else as recipient, else by way of its links."""
    donors = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_custkey").alias("a"))
    recipients = t.customer.where("c_nationkey % 2 = 0").select(F.col("c_nationkey").alias("s_suppkey"), F.col("c_nationkey").alias("b")).distinct()
    links = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.min("l_partkey").alias("d"))
    out = t.supplier.select("s_suppkey").join(donors, "s_suppkey", "left").join(recipients, "s_suppkey", "left").join(links, "s_suppkey", "left")
    way = F.when(F.col("a").isNotNull(), "donor").when(F.col("b").isNotNull(), "recipient").when(F.col("d").isNotNull(), "linked")
    return out.select(F.col("s_suppkey").alias("vendor"), F.coalesce("a", "b", "d").alias("matched"), way.alias("by_way"))


@query("""SELECT f.id, coalesce(l.quality, 0) AS boost, coalesce(c.n, 0) AS accesses FROM v_files f LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = f.id
LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) c ON c.user_id = f.id""")
def row_lookups(t):
    """What would be looked up for each row is aggregated first and joined."""
    boosts = t.labels.groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("boost"))
    accesses = t.events.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("accesses"))
    return t.v_files.select("id").join(boosts, "id", "left").join(accesses, "id", "left").na.fill(0, ["boost", "accesses"])


@query("""SELECT turn, array_to_string(list_sort(list_filter(e, lambda x: NOT list_contains(c, x))), ',') AS missing, array_to_string(list_sort(list_filter(c, lambda x: NOT list_contains(e, x) AND x <> 'terminal')), ',') AS extra
FROM (SELECT turn, coalesce(list(DISTINCT tool_name) FILTER (WHERE session_id % 2 = 0 AND tool_name IS NOT NULL), []) AS e, coalesce(list(DISTINCT tool_name) FILTER (WHERE session_id % 2 = 1 AND tool_name IS NOT NULL), []) AS c FROM v_messages GROUP BY turn)""")
def expected_calls(t):
    """Tools that one run called and the other didn't, and the reverse but for an allowed one."""
    of = lambda rest: F.collect_set(F.when(F.col("session_id") % 2 == rest, F.col("tool_name")))
    sets = t.v_messages.groupBy("turn").agg(of(0).alias("e"), of(1).alias("c"))
    names = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return sets.select("turn", names(F.col("e"), F.col("c")).alias("missing"), names(F.col("c"), F.array_append("e", F.lit("terminal"))).alias("extra"))


@query("SELECT session_id, tool_name, row_number() OVER (PARTITION BY session_id ORDER BY last DESC) AS place FROM (SELECT session_id, tool_name, max(id) AS last FROM v_messages WHERE tool_name IS NOT NULL GROUP BY 1, 2)")
def recent_distinct(t):
    """The distinct tools of a session, the most recently used first."""
    last = t.v_messages.where("tool_name is not null").groupBy("session_id", "tool_name").agg(F.max("id").alias("last"))
    return last.select("session_id", "tool_name", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("last"))).alias("place"))


@query("SELECT session_id, tool_name, n, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first) AS place FROM (SELECT session_id, tool_name, count(*) AS n, min(id) AS first FROM v_messages WHERE tool_name IS NOT NULL GROUP BY 1, 2)")
def most_common(t):
    """Counts from the largest; ties keep the order in which they were first seen."""
    counts = t.v_messages.where("tool_name is not null").groupBy("session_id", "tool_name").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return counts.select("session_id", "tool_name", "n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "first")).alias("place"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 8")
def type_histogram(t):
    return t.part.groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(8)


@query("SELECT doc_id, source, concat('EV-', lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS STRING), 6, '0')) AS evidence_id FROM documents")
def sequential_ids(t):
    """Numbers in order of insertion, for each source by itself."""
    rows = numbering.numbered(t.documents.select("doc_id", "source"), "source", ["doc_id"], "n")
    return rows.select("doc_id", "source", F.concat(F.lit("EV-"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("evidence_id"))


@query(r"SELECT base, concat(base, ' #', CAST(max(CASE WHEN n = '' THEN 1 ELSE CAST(n AS BIGINT) END) + 1 AS STRING)) AS next_title FROM (SELECT regexp_replace(title, ' #\d+$', '') AS base, regexp_extract(title, ' #(\d+)$', 1) AS n FROM v_sessions WHERE title IS NOT NULL) GROUP BY base")
def next_title(t):
    """The title that the next session of a lineage gets: one more than the highest number."""
    titles = t.v_sessions.where("title is not null").select(F.regexp_replace("title", r" #\d+$", "").alias("base"), F.regexp_extract("title", r" #(\d+)$", 1).alias("n"))
    highest = F.max(F.when(F.col("n") == "", 1).otherwise(F.col("n").try_cast("bigint")))
    return titles.groupBy("base").agg(highest.alias("h")).select("base", F.concat("base", F.lit(" #"), (F.col("h") + 1).cast("string")).alias("next_title"))


SEVERITY = "CASE substring(priority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 ELSE 2 END"


@query(f"SELECT id, assignee, place FROM (SELECT id, assignee, row_number() OVER (PARTITION BY assignee ORDER BY {SEVERITY}, id % 3 DESC, id) AS place FROM v_tasks) WHERE place <= 25")
def severity_order(t):
    """By severity, then confidence, then id: the first of each assignee."""
    w = Window.partitionBy("assignee").orderBy(F.expr(SEVERITY), F.desc(F.col("id") % 3), "id")
    return t.v_tasks.select("id", "assignee", F.row_number().over(w).alias("place")).where("place <= 25")


@query("SELECT donor, recipient, p, row_number() OVER (PARTITION BY donor ORDER BY p, recipient) AS place FROM (SELECT l_suppkey AS donor, l_partkey % 20 AS recipient, round(avg(l_discount), 6) AS p FROM lineitem GROUP BY 1, 2)")
def p_value_order(t):
    """Smallest p first; ties in order of the names.

    Discounts are averaged as decimals: sums of doubles depend on the order of rows, and so would an average that ends in
    a 5 at the seventh place. What is no decimal of ten digits before its point (NaN, infinite) leaves its group to doubles.
    """
    exact = F.col("l_discount").try_cast("decimal(28,18)")
    p = F.when(F.count(exact) == F.count("l_discount"), F.round(F.avg(exact), 6).cast("double")).otherwise(F.round(F.avg("l_discount"), 6))
    pairs = t.lineitem.groupBy(F.col("l_suppkey").alias("donor"), (F.col("l_partkey") % 20).alias("recipient")).agg(p.alias("p"))
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("donor").orderBy(F.asc_nulls_last("p"), F.asc_nulls_last("recipient"))))


@query("SELECT doc_id, array_to_string(lines[greatest(len(lines) - 2, 1):len(lines)], chr(10)) AS tail FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)")
def last_lines(t):
    """The last three lines of each text."""
    lines = F.split("text", "\n", -1)
    return t.documents.select("doc_id", F.array_join(F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), F.lit(3)), "\n").alias("tail"))


@query("SELECT session_id, id FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS n FROM v_messages) WHERE n <= 3")
def head_cap(t):
    """The head of each list of items stays."""
    return t.v_messages.select("session_id", "id", F.row_number().over(Window.partitionBy("session_id").orderBy("turn")).alias("n")).where("n <= 3").select("session_id", "id")


@query("SELECT prefix, count(*) AS n, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM (SELECT id, substring(CAST(id AS STRING), 1, 2) AS prefix FROM v_sessions) GROUP BY prefix")
def unique_prefix(t):
    """The id that a prefix stands for; null where it fits several."""
    prefixed = t.v_sessions.select("id", F.substring(F.col("id").cast("string"), 1, 2).alias("prefix"))
    return prefixed.groupBy("prefix").agg(F.count("*").alias("n"), F.min("id").alias("low")).select("prefix", "n", F.when(F.col("n") == 1, F.col("low")).alias("id"))


def _blocks(t):
    block = lambda kind, body: F.struct(F.lit(kind).alias("type"), body.alias("body"))
    return t.v_messages.withColumn("blocks", F.array(block("text", F.col("content")), block("image", F.lit("data:")), block("text", F.col("role"))))


@query("SELECT id, concat_ws(chr(10), content, '[screenshot]', role) AS said FROM v_messages")
def image_placeholder(t):
    """Image blocks become a placeholder."""
    shown = F.transform("blocks", lambda b: F.when(b["type"] == "image", "[screenshot]").otherwise(b["body"]))
    return _blocks(t).select("id", F.array_join(shown, "\n").alias("said"))


@query("SELECT id, concat_ws(chr(10), content, role) AS said FROM v_messages")
def flatten_blocks(t):
    """The text parts of a message, a line each."""
    parts = F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["body"])
    return _blocks(t).select("id", F.array_join(parts, "\n").alias("said"))


@query(f"SELECT id, tool_name, CASE WHEN json_valid(a) THEN coalesce(json_extract_string(a, '$.path'), '') ELSE '' END AS path FROM (SELECT id, tool_name, {ARGS} AS a FROM v_messages WHERE tool_name IS NOT NULL)")
def tool_arguments(t):
    """Arguments that are no JSON count as none."""
    called = t.v_messages.where("tool_name is not null").select("id", "tool_name", F.expr(ARGS).alias("a"))
    return called.select("id", "tool_name", F.when(F.try_parse_json("a").isNotNull(), F.coalesce(F.get_json_object("a", "$.path"), F.lit(""))).otherwise("").alias("path"))


@query(rf"SELECT id, substring(trim(regexp_replace(coalesce(CASE WHEN json_valid(r) THEN json_extract_string(r, '$.error') END, r), '\s+', ' ', 'g')), 1, 180) AS preview FROM (SELECT id, {RESULT} AS r FROM v_files)")
def error_preview(t):
    """The error a result names, else the whole result, on one line of 180 characters at most."""
    said = F.coalesce(F.get_json_object("r", "$.error"), F.col("r"))
    return t.v_files.select("id", F.expr(RESULT).alias("r")).select("id", F.substring(F.trim(F.regexp_replace(said, r"\s+", " ")), 1, 180).alias("preview"))


@query(rf"SELECT id, CAST(CASE WHEN regexp_full_match(s, '\d+\s*[smhd]') THEN CAST(regexp_extract(s, '\d+') AS BIGINT) * CASE right(s, 1) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END END AS BIGINT) AS seconds FROM (SELECT id, {SINCE} AS s FROM v_sessions)")
def parse_since(t):
    """Seconds of a span like 30m or 2 h; null for anything else."""
    unit = F.create_map(*[F.lit(x) for pair in {"s": 1, "m": 60, "h": 3600, "d": 86400}.items() for x in pair])
    seconds = F.regexp_extract("s", r"^(\d+)", 1).try_cast("bigint") * F.try_element_at(unit, F.substring("s", -1, 1))
    return t.v_sessions.select("id", F.expr(SINCE).alias("s")).select("id", F.when(F.col("s").rlike(r"^\d+\s*[smhd]$"), seconds).cast("bigint").alias("seconds"))


@query(rf"SELECT id, regexp_extract(r, '(?:^|; )DOB ([^;]*)', 1) AS born, regexp_extract(r, '(?:^|; )POB ([^;]*)', 1) AS place, regexp_extract(r, '(?:^|; )Passport ([^;]*)', 1) AS passport FROM (SELECT id, {REMARK} AS r FROM v_sessions)")
def remark_fields(t):
    """Named parts of a remark; empty where there is none."""
    field = lambda name: F.regexp_extract("r", rf"(?:^|; ){name} ([^;]*)", 1)
    return t.v_sessions.select("id", F.expr(REMARK).alias("r")).select("id", field("DOB").alias("born"), field("POB").alias("place"), field("Passport").alias("passport"))


@query("SELECT id, CASE WHEN v >= 1000000 THEN concat(CAST(round(v / 1000000.0, 1) AS STRING), 'M') WHEN v >= 1000 THEN concat(CAST(round(v / 1000.0, 1) AS STRING), 'K') ELSE CAST(v AS STRING) END AS shown FROM (SELECT id, id * 7919 % 3000000 AS v FROM v_sessions)")
def human_number(t):
    short = lambda unit, mark: F.concat(F.round(F.col("v") / unit, 1).cast("string"), F.lit(mark))
    shown = F.when(F.col("v") >= 1_000_000, short(1e6, "M")).when(F.col("v") >= 1000, short(1e3, "K")).otherwise(F.col("v").cast("string"))
    return t.v_sessions.selectExpr("id", "id * 7919 % 3000000 AS v").select("id", shown.alias("shown"))


HEADER = "CASE id % 4 WHEN 0 THEN '120' WHEN 1 THEN '7.5' WHEN 2 THEN 'none' ELSE '' END"


@query(f"SELECT id, coalesce(TRY_CAST(h AS DOUBLE), 0.0) AS remaining, lower(concat('X-Rate-', title)) AS header FROM (SELECT id, coalesce(title, 'None') AS title, {HEADER} AS h FROM v_sessions)")
def safe_numbers(t):
    """Numbers of headers whose names are lower-cased; what is none counts as the default."""
    return t.v_sessions.select("id", F.coalesce("title", F.lit("None")).alias("title"), F.expr(HEADER).alias("h")).select("id", F.coalesce(F.col("h").try_cast("double"), F.lit(0.0)).alias("remaining"), F.lower(F.concat(F.lit("X-Rate-"), "title")).alias("header"))


@query("SELECT l_orderkey AS filing, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS entities, array_to_string(list(CAST(l_suppkey AS STRING) ORDER BY l_linenumber, l_suppkey, p), ',') AS issues FROM (SELECT *, unnest([1, 2]) AS p FROM lineitem WHERE l_quantity > 25) GROUP BY 1")
def nested_lists(t):
    """Lists in the lists of a filing: one as a sorted set, the other with repeats and in order."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", F.array("l_suppkey", "l_suppkey").alias("issues"), "l_returnflag")))
    filings = t.lineitem.where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("filing")).agg(rows.alias("activities"))
    issues = F.transform(F.flatten("activities.issues"), lambda x: x.cast("string"))
    return filings.select("filing", F.array_join(F.array_sort(F.array_distinct("activities.l_returnflag")), ",").alias("entities"), F.array_join(issues, ",").alias("issues"))


@query("""WITH a AS (SELECT id, title, row_number() OVER (PARTITION BY source ORDER BY started_at) AS place, source FROM v_sessions WHERE title IS NOT NULL)
SELECT source, coalesce(max(CASE WHEN id = 7 THEN id END), max(CASE WHEN place = 3 THEN id END), max(CASE WHEN lower(title) = 'session #9' THEN id END)) AS resolved FROM a GROUP BY source""")
def resolve_pending(t):
    """A reference as an id, else a place in the pending list, else a title in any case."""
    pending = t.v_sessions.where("title is not null").withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("started_at")))
    pick = lambda cond: F.max(F.when(cond, F.col("id")))
    return pending.groupBy("source").agg(F.coalesce(pick(F.col("id") == 7), pick(F.col("place") == 3), pick(F.lower("title") == "session #9")).alias("resolved"))


@query("SELECT source, id FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY started_at, id) AS n FROM v_sessions WHERE ended_at IS NULL) WHERE n <= 2")
def lease_admission(t):
    """Ended leases are pruned; the earliest up to the cap are admitted."""
    w = Window.partitionBy("source").orderBy("started_at", "id")
    return t.v_sessions.where("ended_at is null").select("source", "id", F.row_number().over(w).alias("n")).where("n <= 2").select("source", "id")


@query("SELECT id, CASE WHEN ended_at IS NULL THEN 'live' ELSE 'orphan' END AS state FROM v_sessions ORDER BY started_at DESC, id LIMIT 20")
def checkpoint_listing(t):
    """The twenty checkpoints last touched, with their state."""
    return t.v_sessions.orderBy(F.desc("started_at"), "id").limit(20).select("id", F.when(F.col("ended_at").isNull(), "live").otherwise("orphan").alias("state"))


#: An edit script: lines [from, to) are equal and move by shift; other lines are gone.
EDITS = ((0, 3, 0), (5, 9, -2), (9, 40, 4))


def remapped(line: Column, edits=EDITS) -> Column:
    """Where a line is after the edits: moved, or null where it was deleted or replaced; past the end, the last line."""
    end, shift = edits[-1][1], edits[-1][2]
    out = F.when(line >= end, F.lit(end - 1 + shift))
    for a, b, by in edits:
        out = out.when((line >= a) & (line < b), line + by)
    return out


@query("SELECT id, turn, CASE WHEN turn >= 40 THEN 43 WHEN turn < 3 THEN turn WHEN turn >= 5 AND turn < 9 THEN turn - 2 WHEN turn >= 9 THEN turn + 4 END AS line FROM v_messages")
def line_remap(t):
    return t.v_messages.select("id", "turn", remapped(F.col("turn")).alias("line"))


@query("SELECT assignee, array_to_string(list(CAST(id AS STRING) ORDER BY id) FILTER (WHERE n <= 3), ',') AS shown, concat('+', CAST(count(*) - 3 AS STRING), ' more') AS more FROM (SELECT assignee, id, row_number() OVER (PARTITION BY assignee ORDER BY id) AS n FROM v_tasks WHERE status = 'running') GROUP BY assignee HAVING count(*) > 3")
def first_and_more(t):
    """The first findings of each, and how many more there are."""
    running = t.v_tasks.where("status = 'running'")
    first = running.withColumn("n", F.row_number().over(Window.partitionBy("assignee").orderBy("id"))).where("n <= 3").groupBy("assignee").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    total = running.groupBy("assignee").agg(F.count("*").alias("m")).where("m > 3")
    shown = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return first.join(total, "assignee").select("assignee", shown.alias("shown"), F.concat(F.lit("+"), (F.col("m") - 3).cast("string"), F.lit(" more")).alias("more"))


@query("SELECT id FROM v_files WHERE starts_with(path, '/src1')")
def prefix_filter(t):
    return t.v_files.where(F.col("path").startswith("/src1")).select("id")


@query("SELECT id, CASE WHEN failed THEN 'failed' WHEN tool_name IS NULL THEN 'pending' WHEN turn % 2 = 0 THEN 'running' ELSE 'done' END AS state FROM v_messages WHERE role = 'assistant'")
def handoff_states(t):
    state = F.when(F.col("failed"), "failed").when(F.col("tool_name").isNull(), "pending").when(F.col("turn") % 2 == 0, "running").otherwise("done")
    return t.v_messages.where("role = 'assistant'").select("id", state.alias("state"))


@query("SELECT id, CASE WHEN role = 'system' THEN 'control' WHEN tool_name IS NOT NULL THEN 'tool' WHEN role = 'assistant' THEN 'answer' ELSE 'input' END AS route FROM v_messages")
def event_routing(t):
    """The handler that each kind of event goes to."""
    route = F.when(F.col("role") == "system", "control").when(F.col("tool_name").isNotNull(), "tool").when(F.col("role") == "assistant", "answer").otherwise("input")
    return t.v_messages.select("id", route.alias("route"))


@query("SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n FROM (SELECT source, input_tokens + CASE WHEN id % 2 = 0 THEN output_tokens ELSE 0 END AS tokens FROM v_sessions) GROUP BY source")
def incremental_contributions(t):
    """Totals kept up to date: the old contributions of changed sessions are taken off, the new ones added."""
    s = t.v_sessions
    totals = s.select("source", F.col("input_tokens").alias("tokens"), F.lit(1).alias("n"))
    changed = s.where("id % 2 = 0")
    off = changed.select("source", (-F.col("input_tokens")).alias("tokens"), F.lit(-1).alias("n"))
    on = changed.select("source", (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.lit(1).alias("n"))
    return totals.unionByName(off).unionByName(on).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n"))


@query("SELECT id, 'f' || CAST(turn AS STRING) AS url, CAST(turn * 10 AS STRING) AS status FROM v_messages WHERE turn > 0")
def header_row(t):
    """Payloads whose first row names the columns, an array of arrays as JSON."""
    payload = F.expr("concat('[[\"status\",\"url\"],[\"', cast(turn * 10 as string), '\",\"f', cast(turn as string), '\"]]')")
    rows = t.v_messages.where("turn > 0").select("id", F.from_json(payload, "array<array<string>>").alias("p"))
    named = rows.select("id", F.explode(F.slice("p", F.lit(2), F.size("p"))).alias("row"), F.get("p", F.lit(0)).alias("names"))
    at = lambda name: F.get("row", F.array_position("names", F.lit(name)).cast("int") - 1)
    return named.select("id", at("url").alias("url"), at("status").alias("status"))
