"""Plans over sessions, messages and trajectories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lineage
from ..operators import sessions as ops
from .base import query


@query("SELECT model, count(*) AS sessions, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens * 3 + output_tokens * 15) AS BIGINT) AS micro_usd FROM v_sessions WHERE model IS NOT NULL GROUP BY model")
def usage_by_model(t):
    s = t.v_sessions.where(F.col("model").isNotNull())
    return s.groupBy("model").agg(F.count("*").alias("sessions"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.col("input_tokens") * 3 + F.col("output_tokens") * 15).alias("micro_usd")).orderBy(F.desc("micro_usd"))


@query("SELECT id, session_id, turn - (SELECT turn FROM v_messages WHERE id = 7003) AS \"offset\" FROM v_messages WHERE session_id = 7 AND abs(turn - (SELECT turn FROM v_messages WHERE id = 7003)) <= 2")
def messages_around(t):
    return ops.around(t.v_messages, 7003, 2).select("id", "session_id", F.col("offset").cast("long").alias("offset"))


@query("""SELECT id, kind FROM (SELECT id, CASE WHEN abs(turn - 3) <= 1 THEN 'window' WHEN f <= 1 AND turn < 2 THEN 'start' WHEN l <= 1 AND turn > 4 THEN 'end' END AS kind FROM
(SELECT id, turn, row_number() OVER (ORDER BY turn) AS f, row_number() OVER (ORDER BY turn DESC) AS l FROM v_messages WHERE session_id = 7 AND role IN ('user', 'assistant') AND trim(content) <> '')) WHERE kind IS NOT NULL""")
def anchored_view(t):
    prose = t.v_messages.where((F.col("session_id") == 7) & F.col("role").isin("user", "assistant") & (F.trim("content") != ""))
    w = Window.partitionBy("session_id")
    placed = prose.select("id", "turn", F.row_number().over(w.orderBy("turn")).alias("f"), F.row_number().over(w.orderBy(F.desc("turn"))).alias("l"))
    kind = F.when(F.abs(F.col("turn") - 3) <= 1, "window").when((F.col("f") <= 1) & (F.col("turn") < 2), "start").when((F.col("l") <= 1) & (F.col("turn") > 4), "end")
    return placed.select("id", kind.alias("kind")).where("kind IS NOT NULL")


@query("""SELECT id, session_id FROM (SELECT id, session_id, sum(CASE WHEN role IN ('user', 'assistant') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM v_messages) WHERE coalesce(seen, 0) < 4""")
def recent_window(t):
    w = Window.partitionBy("session_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.col("role").isin("user", "assistant").cast("int")).over(w), F.lit(0))
    return t.v_messages.select("id", "session_id", seen.alias("seen")).where("seen < 4").select("id", "session_id")


@query("""SELECT session_id, CAST(sum(CASE WHEN users >= 2 AND NOT (users = 2 AND role = 'user') THEN 1 ELSE 0 END) AS BIGINT) AS head, CAST(sum(CASE WHEN users < 2 OR (users = 2 AND role = 'user') THEN 1 ELSE 0 END) AS BIGINT) AS tail
FROM (SELECT session_id, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn DESC) AS users FROM v_messages) GROUP BY session_id""")
def partial_split(t):
    """Head and tail sizes when the tail starts at the second last user message."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    placed = t.v_messages.select("session_id", "role", F.sum((F.col("role") == "user").cast("int")).over(w).alias("users"))
    in_tail = (F.col("users") < 2) | ((F.col("users") == 2) & (F.col("role") == "user"))
    return placed.groupBy("session_id").agg(F.sum((~in_tail).cast("long")).alias("head"), F.sum(in_tail.cast("long")).alias("tail"))


@query("SELECT session_id, arg_max(content, turn) FILTER (WHERE role = 'user') AS prompt, arg_max(content, turn) FILTER (WHERE role = 'assistant') AS reply FROM v_messages WHERE trim(content) <> '' GROUP BY session_id")
def latest_prompt(t):
    said = t.v_messages.where(F.trim("content") != "")
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("content")), F.when(F.col("role") == role, F.col("turn")))
    return said.groupBy("session_id").agg(last("user").alias("prompt"), last("assistant").alias("reply"))


@query("""WITH pv AS (SELECT session_id, arg_min(substring(content, 1, 63), turn) AS preview FROM v_messages WHERE role = 'user' GROUP BY 1), la AS (SELECT session_id, max(ts) AS last_active FROM v_messages GROUP BY 1)
SELECT s.id, preview, coalesce(last_active, started_at) AS last_active FROM v_sessions s LEFT JOIN pv ON pv.session_id = s.id LEFT JOIN la ON la.session_id = s.id WHERE source <> 'tool' ORDER BY 3 DESC, 1 LIMIT 20""")
def recent_sessions_preview(t):
    m = t.v_messages
    facts = m.groupBy("session_id").agg(F.min_by(F.when(F.col("role") == "user", F.substring("content", 1, 63)), F.when(F.col("role") == "user", F.col("turn"))).alias("preview"), F.max("ts").alias("last_active"))
    s = t.v_sessions.where("source <> 'tool'").join(facts.withColumnRenamed("session_id", "id"), "id", "left")
    return s.select("id", "preview", F.coalesce("last_active", "started_at").alias("last_active")).orderBy(F.desc("last_active"), "id").limit(20)


@query("SELECT id, source, started_at FROM v_sessions WHERE source <> 'tool' AND title IS NOT NULL AND id <> 9 ORDER BY started_at DESC, id LIMIT 15")
def session_listing(t):
    """Filters come before the limit, so it is always filled where rows are left."""
    return t.v_sessions.where("source <> 'tool' AND title IS NOT NULL AND id <> 9").orderBy(F.desc("started_at"), "id").select("id", "source", "started_at").limit(15)


@query("SELECT s.id FROM v_sessions s WHERE s.title IS NULL AND NOT EXISTS (SELECT 1 FROM v_messages m WHERE m.session_id = s.id AND m.role = 'system') AND NOT EXISTS (SELECT 1 FROM v_sessions c WHERE c.parent_session_id = s.id)")
def empty_sessions(t):
    said = t.v_messages.where("role = 'system'").select(F.col("session_id").alias("id"))
    children = t.v_sessions.select(F.col("parent_session_id").alias("id"))
    return t.v_sessions.where("title IS NULL").join(said, "id", "left_anti").join(children, "id", "left_anti").select("id")


@query("SELECT id, started_at FROM v_sessions WHERE NOT (ended_at IS NOT NULL AND started_at < 1704067200 + 48 * 3600 AND source = 'cli')")
def prune_sessions(t):
    old = F.col("ended_at").isNotNull() & (F.col("started_at") < 1704067200 + 48 * 3600) & (F.col("source") == "cli")
    return t.v_sessions.where(~old).select("id", "started_at")


@query("WITH RECURSIVE t(id, parent_session_id, depth) AS (SELECT id, parent_session_id, 0 FROM v_sessions WHERE id = 13 UNION ALL SELECT s.id, s.parent_session_id, t.depth + 1 FROM v_sessions s JOIN t ON s.id = t.parent_session_id) SELECT id, depth FROM t")
def lineage_ancestors(t):
    return ops.lineage(t.v_sessions.select("id", "parent_session_id"), 13)


@query("WITH RECURSIVE t(id, parent_session_id, depth) AS (SELECT id, parent_session_id, 0 FROM v_sessions WHERE id = 10 UNION ALL SELECT s.id, s.parent_session_id, t.depth + 1 FROM v_sessions s JOIN t ON s.parent_session_id = t.id) SELECT id, depth FROM t")
def lineage_descendants(t):
    return ops.lineage(t.v_sessions.select("id", "parent_session_id"), 10, up=False)


@query("""WITH RECURSIVE t(id, depth, started_at) AS (SELECT id, 0, started_at FROM v_sessions WHERE id = 10 UNION ALL SELECT s.id, t.depth + 1, s.started_at FROM v_sessions s JOIN t ON s.parent_session_id = t.id)
SELECT t.id FROM t WHERE EXISTS (SELECT 1 FROM v_messages m WHERE m.session_id = t.id AND m.role = 'system') ORDER BY depth, started_at DESC LIMIT 1""")
def resume_target(t):
    """The nearest descendant, newest first, with messages of note."""
    s = t.v_sessions
    down = ops.lineage(s.select("id", "parent_session_id"), 10, up=False).join(s.select("id", "started_at"), "id")
    noted = t.v_messages.where("role = 'system'").select(F.col("session_id").alias("id"))
    return down.join(noted, "id", "left_semi").orderBy("depth", F.desc("started_at")).limit(1).select("id")


@query("SELECT source, CASE WHEN count(*) FILTER (WHERE model = 'alpha') = 1 THEN max(CASE WHEN model = 'alpha' THEN id END) WHEN count(*) FILTER (WHERE model = 'alpha') > 1 THEN NULL ELSE arg_max(id, started_at) END AS target FROM v_sessions GROUP BY source")
def mirror_target(t):
    s = t.v_sessions
    exact = F.count_if(F.col("model") == "alpha")
    return s.groupBy("source").agg(F.when(exact == 1, F.max(F.when(F.col("model") == "alpha", F.col("id")))).when(exact > 1, F.lit(None)).otherwise(F.max_by("id", "started_at")).alias("target"))


@query("""SELECT root, arg_min(id, prio * 100000000 + id) AS hit, min(prio) AS prio FROM (SELECT id - id % 5 AS root, id, 0 AS prio FROM v_sessions WHERE CAST(id AS STRING) LIKE '1%'
UNION ALL SELECT session_id - session_id % 5, session_id, 1 FROM v_messages WHERE content LIKE '%the%') GROUP BY root""")
def search_merge(t):
    """Hits by id come before hits by content; one hit for each lineage root."""
    by_id = t.v_sessions.where(F.col("id").cast("string").startswith("1")).select("id", F.lit(0).alias("prio"))
    by_text = t.v_messages.where(F.col("content").contains("the")).select(F.col("session_id").alias("id"), F.lit(1).alias("prio"))
    hits = by_id.unionByName(by_text.distinct()).join(lineage.roots(t.v_sessions).select("id", "root"), "id")
    return hits.groupBy("root").agg(F.min_by("id", F.struct("prio", "id")).alias("hit"), F.min("prio").alias("prio"))


@query("WITH RECURSIVE t(id, root, depth) AS (SELECT id, id, 0 FROM v_sessions WHERE parent_session_id IS NULL UNION ALL SELECT s.id, t.root, t.depth + 1 FROM v_sessions s JOIN t ON s.parent_session_id = t.id) SELECT id, root, CAST(depth AS BIGINT) AS depth FROM t")
def session_roots(t):
    return lineage.roots(t.v_sessions)


@query("""WITH RECURSIVE said AS (SELECT DISTINCT session_id AS id FROM v_messages WHERE role = 'system' AND session_id % 3 = 0), child AS (SELECT parent_session_id AS id, arg_max(id, started_at) AS child FROM v_sessions WHERE parent_session_id IS NOT NULL GROUP BY 1),
w(id, here, d) AS (SELECT id, id, 0 FROM v_sessions UNION ALL SELECT w.id, child.child, d + 1 FROM w JOIN child ON child.id = w.here WHERE w.here NOT IN (SELECT id FROM said))
SELECT id, coalesce(max(CASE WHEN here IN (SELECT id FROM said) THEN here END), id) AS target FROM w GROUP BY id""")
def resume_targets(t):
    """Where each session resumes: on its way by newest children, the first with messages of note, else itself."""
    return lineage.resume_targets(t.v_sessions, t.v_messages.where("role = 'system' AND session_id % 3 = 0").select(F.col("session_id").alias("id")))


@query("SELECT id, input_tokens + output_tokens AS tokens FROM v_sessions ORDER BY 2 DESC, 1 LIMIT 10")
def top_sessions(t):
    return t.v_sessions.select("id", (F.col("input_tokens") + F.col("output_tokens")).alias("tokens")).orderBy(F.desc("tokens"), "id").limit(10)


@query("SELECT session_id AS id, max(ts) AS last_active FROM v_messages GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1")
def mru_session(t):
    return t.v_messages.groupBy(F.col("session_id").alias("id")).agg(F.max("ts").alias("last_active")).orderBy(F.desc("last_active"), F.desc("id")).limit(1)


@query("SELECT session_id, count(*) FILTER (WHERE role = 'user') AS users, count(*) FILTER (WHERE role = 'assistant') AS assistants, count(tool_name) AS tools FROM v_messages GROUP BY session_id")
def role_counts(t):
    return t.v_messages.groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"), F.count("tool_name").alias("tools"))


@query("SELECT tool_name, count(*) AS calls FROM v_messages WHERE tool_name IS NOT NULL GROUP BY tool_name")
def tool_counts(t):
    return t.v_messages.where("tool_name IS NOT NULL").groupBy("tool_name").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "tool_name")


@query("SELECT tool_name, count(*) AS calls, count(*) FILTER (WHERE NOT failed) AS succeeded, count(*) FILTER (WHERE failed) AS broke, round(100.0 * count(*) FILTER (WHERE NOT failed) / count(*), 2) AS rate FROM v_messages WHERE tool_name IS NOT NULL GROUP BY tool_name")
def tool_stats(t):
    ok = F.count_if(~F.col("failed"))
    return t.v_messages.where("tool_name IS NOT NULL").groupBy("tool_name").agg(F.count("*").alias("calls"), ok.alias("succeeded"), F.count_if("failed").alias("broke"), F.round(100.0 * ok / F.count("*"), 2).alias("rate"))


@query("""WITH k AS (SELECT DISTINCT tool_name FROM v_messages WHERE tool_name IS NOT NULL), c AS (SELECT session_id, tool_name, count(*) AS n FROM v_messages WHERE tool_name IS NOT NULL GROUP BY 1, 2)
SELECT s.id AS session_id, k.tool_name, coalesce(n, 0) AS n FROM v_sessions s, k LEFT JOIN c ON c.session_id = s.id AND c.tool_name = k.tool_name""")
def tool_stats_dense(t):
    """Every session with every tool, so that columns of a dense map agree: one pass, zero-filled."""
    tools = ("read_file", "terminal", "web_search")
    counted = t.v_messages.groupBy("session_id").agg(*[F.count_if(F.col("tool_name") == x).alias(x) for x in tools])
    pairs = F.array(*[F.struct(F.lit(x).alias("tool_name"), F.col(x).alias("n")) for x in tools])
    return counted.select("session_id", F.explode(pairs).alias("p")).select("session_id", "p.tool_name", "p.n")


@query("SELECT round(100.0 * sum(CASE WHEN marked LIKE '%<think>%' THEN 1 ELSE 0 END) / count(*), 4) AS coverage, count(*) AS turns FROM v_messages WHERE role = 'assistant'")
def reasoning_coverage(t):
    return t.v_messages.where("role = 'assistant'").agg(F.round(100.0 * F.count_if(F.col("marked").contains("<think>")) / F.count("*"), 4).alias("coverage"), F.count("*").alias("turns"))


@query("SELECT session_id, bool_or(role = 'assistant' AND marked LIKE '%<think>%') AS kept, TRUE AS completed FROM v_messages GROUP BY session_id")
def reasoning_filter(t):
    """Samples without reasoning are discarded, yet count as completed."""
    return t.v_messages.groupBy("session_id").agg(F.bool_or((F.col("role") == "assistant") & F.col("marked").contains("<think>")).alias("kept"), F.lit(True).alias("completed"))


@query("SELECT session_id, CAST(sum(CASE WHEN turn % 3 = 0 THEN length(content) // 4 ELSE length(content) // 5 END) AS BIGINT) AS tokens FROM v_messages GROUP BY session_id")
def conv_token_estimate(t):
    """A turn's own count where it has one, else a quarter of its characters."""
    known = F.when(F.col("turn") % 3 != 0, F.floor(F.length("content") / 5))
    return t.v_messages.groupBy("session_id").agg(F.sum(F.coalesce(known, F.floor(F.length("content") / 4))).alias("tokens"))


TOK = "input_tokens + output_tokens"


@query(f"SELECT min({TOK}) AS least, max({TOK}) AS most, round(avg({TOK}), 4) AS mean FROM v_sessions")
def token_stats(t):
    n = F.col("input_tokens") + F.col("output_tokens")
    return t.v_sessions.agg(F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 4).alias("mean"))


@query(f"SELECT id, {TOK} AS tokens FROM v_sessions WHERE {TOK} >= 300")
def token_threshold_filter(t):
    return t.v_sessions.select("id", F.expr(TOK).alias("tokens")).where("tokens >= 300")


@query("SELECT label, count(*) AS n FROM (SELECT split_part(concat('org/set/', source), '/', -1) AS label FROM documents) GROUP BY label")
def sample_distribution(t):
    return t.documents.select(F.substring_index(F.concat(F.lit("org/set/"), F.col("source")), "/", -1).alias("label")).groupBy("label").agg(F.count("*").alias("n")).orderBy("label")


@query("SELECT m.session_id, m.content AS prompt FROM v_messages m WHERE m.turn = 1 AND NOT EXISTS (SELECT 1 FROM v_messages d WHERE d.turn = 1 AND d.session_id % 4 = 0 AND d.content = m.content)")
def resume_antijoin(t):
    """Prompts not done yet are known by their text, not by their place."""
    prompts = t.v_messages.where("turn = 1")
    done = prompts.where("session_id % 4 = 0").select("content")
    return prompts.join(done, "content", "left_anti").select("session_id", F.col("content").alias("prompt"))


@query("SELECT doc_id FROM documents ORDER BY md5(concat(CAST(doc_id AS STRING), '42')), doc_id LIMIT 100")
def sample_n(t):
    return t.documents.select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("42"))), "doc_id").limit(100)


U = "CAST(concat('0x', substring(md5(concat(CAST(id AS STRING), tool)), 1, 6)) AS BIGINT) / 16777216.0"


@query(f"""WITH d AS (SELECT 'web' AS tool, 0.3 AS pct UNION ALL SELECT 'terminal', 0.2 UNION ALL SELECT 'file', 0.1), r AS (SELECT s.id, tool, pct, {U} AS u FROM v_sessions s, d),
g AS (SELECT id, list_sort(list(tool) FILTER (WHERE u < pct)) AS hit, arg_max(tool, pct) AS top FROM r GROUP BY id)
SELECT id, CASE WHEN hit IS NULL OR len(hit) = 0 THEN top ELSE array_to_string(hit, ',') END AS tools FROM g""")
def toolset_sample(t):
    """Each toolset with its own chance; if none is drawn, the likeliest."""
    tools = {"web": 0.3, "terminal": 0.2, "file": 0.1}
    u = lambda x: F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(x))), 1, 6), 16, 10).cast("long") / 16777216.0
    drawn = F.array_compact(F.array(*[F.when(u(x) < p, F.lit(x)) for x, p in sorted(tools.items())]))
    return t.v_sessions.select("id", drawn.alias("d")).select("id", F.when(F.size("d") > 0, F.array_join("d", ",")).otherwise(max(tools, key=tools.get)).alias("tools"))


@query("""SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY session_id, role ORDER BY turn) AS r, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS b FROM v_messages) WHERE r = 1 OR b <= 4""")
def protected_turns(t):
    return ops.first_of_role(t.v_messages, 4).select("id")


@query("""SELECT id, session_id, length(content) AS size FROM (SELECT *, sum(length(content)) OVER (PARTITION BY session_id) - coalesce(sum(length(content) - 100) OVER (PARTITION BY session_id ORDER BY length(content) DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total FROM v_messages) WHERE total > 800""")
def turn_budget_spill(t):
    rows = t.v_messages.select("id", "session_id", F.length("content").cast("long").alias("size"))
    return ops.spill(rows, "session_id", "id", "size", 800, F.col("size") - 100)


@query("SELECT id FROM (SELECT id, sum(length(content) // 4 + 10) OVER (PARTITION BY session_id ORDER BY turn DESC) AS s, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM v_messages) WHERE s <= 150 OR rn = 1")
def tail_budget_cut(t):
    return ops.tail_within(t.v_messages, 150, F.floor(F.length("content") / 4) + 10).select("id")


SEAM = "CASE WHEN session_id % 2 = 0 AND turn % 5 = 2 THEN 'user' ELSE role END"


@query(f"""WITH m AS (SELECT session_id, turn, {SEAM} AS role, content FROM v_messages), r AS (SELECT *, sum(CASE WHEN lag_role IS NULL OR lag_role <> role OR role = 'tool' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn) AS run FROM (SELECT *, lag(role) OVER (PARTITION BY session_id ORDER BY turn) AS lag_role FROM m))
SELECT session_id, CAST(run AS BIGINT) AS run, any_value(role) AS role, string_agg(content, chr(10) ORDER BY turn) AS content FROM r GROUP BY session_id, run""")
def merge_same_role(t):
    return ops.merge_runs(t.v_messages.select("session_id", "turn", F.expr(SEAM).alias("role"), "content")).withColumn("run", F.col("run").cast("long"))


@query("""SELECT session_id, string_agg(concat(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, ': ', CASE WHEN role = 'assistant' AND marked NOT LIKE '%<think>%' THEN concat('<think>', chr(10), '</think>', chr(10), marked) ELSE marked END), chr(10) ORDER BY turn) AS conversation FROM v_messages GROUP BY session_id""")
def to_sharegpt(t):
    who = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    body = F.when((F.col("role") == "assistant") & ~F.col("marked").contains("<think>"), F.concat(F.lit("<think>\n</think>\n"), F.col("marked"))).otherwise(F.col("marked"))
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat(who, F.lit(": "), body).alias("s"))))
    return t.v_messages.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), "\n").alias("conversation"))


@query("SELECT day, count(*) AS sessions, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens FROM (SELECT started_at // 86400 AS day, * FROM v_sessions WHERE started_at >= 1704067200 + 86400) GROUP BY day")
def insights_daily(t):
    s = t.v_sessions.where(F.col("started_at") >= 1704067200 + 86400)
    return s.groupBy(F.floor(F.col("started_at") / 86400).alias("day")).agg(F.count("*").alias("sessions"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))


@query("SELECT source, tool_name, count(*) AS calls FROM v_messages m JOIN v_sessions s ON s.id = m.session_id WHERE tool_name IS NOT NULL GROUP BY source, tool_name")
def insights_tools(t):
    return t.v_messages.where("tool_name IS NOT NULL").join(t.v_sessions.select(F.col("id").alias("session_id"), "source"), "session_id").groupBy("source", "tool_name").agg(F.count("*").alias("calls"))


@query("SELECT id, greatest(0, input_tokens - input_tokens // 3 - input_tokens // 5) AS input, input_tokens // 3 AS cache_read, input_tokens // 5 AS cache_write FROM v_sessions")
def usage_normalize(t):
    """Prompt tokens less what the cache read and wrote."""
    read, wrote = F.floor(F.col("input_tokens") / 3), F.floor(F.col("input_tokens") / 5)
    return t.v_sessions.select("id", F.greatest(F.lit(0), F.col("input_tokens") - read - wrote).alias("input"), read.alias("cache_read"), wrote.alias("cache_write"))


@query("""SELECT id, CASE WHEN model = 'alpha' THEN 'estimated' WHEN model = 'beta' THEN 'included' ELSE 'unknown' END AS status,
CAST(CASE WHEN model = 'alpha' THEN (input_tokens * 1.74 + output_tokens * 3.48) / 1000000 WHEN model = 'beta' THEN 0 END AS DOUBLE) AS usd FROM v_sessions""")
def cost_estimate(t):
    cost = F.when(F.col("model") == "alpha", (F.col("input_tokens") * F.lit(1.74) + F.col("output_tokens") * F.lit(3.48)) / 1e6).when(F.col("model") == "beta", F.lit(0.0))
    status = F.when(F.col("model") == "alpha", "estimated").when(F.col("model") == "beta", "included").otherwise("unknown")
    return t.v_sessions.select("id", status.alias("status"), cost.alias("usd"))


@query("SELECT id, CASE WHEN id % 50 <= 0 THEN 0.0 ELSE round(100.0 * greatest(0, id % 50 - id % 30) / (id % 50), 4) END AS pct FROM v_sessions")
def rate_usage(t):
    limit, left = F.col("id") % 50, F.col("id") % 30
    return t.v_sessions.select("id", F.when(limit <= 0, 0.0).otherwise(F.round(100.0 * F.greatest(F.lit(0), limit - left) / F.greatest(limit, F.lit(1)), 4)).alias("pct"))


@query("SELECT session_id, count(tool_name) AS calls, count(*) FILTER (WHERE failed AND tool_name IS NOT NULL) AS errors, bool_or(regexp_matches(content, '(?i)port|address')) AS port_conflict FROM v_messages GROUP BY session_id")
def session_signals(t):
    return t.v_messages.groupBy("session_id").agg(F.count("tool_name").alias("calls"), F.count_if(F.col("failed") & F.col("tool_name").isNotNull()).alias("errors"), F.bool_or(F.col("content").rlike("(?i)port|address")).alias("port_conflict"))


@query("""WITH s AS (SELECT session_id, count(tool_name) AS calls FROM v_messages GROUP BY 1)
SELECT CAST(sum(calls) AS BIGINT) AS total_calls, max(calls) AS max_calls, count(DISTINCT model) AS models FROM s JOIN v_sessions v ON v.id = s.session_id""")
def achievement_metrics(t):
    calls = t.v_messages.groupBy(F.col("session_id").alias("id")).agg(F.count("tool_name").alias("calls"))
    return calls.join(t.v_sessions, "id").agg(F.sum("calls").alias("total_calls"), F.max("calls").alias("max_calls"), F.countDistinct("model").alias("models"))


@query("""WITH s AS (SELECT session_id, CAST(sum(length(content)) AS BIGINT) AS metric FROM v_messages GROUP BY 1)
SELECT session_id, metric, CASE WHEN metric >= 1500 THEN 'gold' WHEN metric >= 800 THEN 'silver' WHEN metric >= 300 THEN 'bronze' END AS tier,
CASE WHEN metric >= 1500 THEN NULL WHEN metric >= 800 THEN 1500 WHEN metric >= 300 THEN 800 ELSE 300 END AS next_at FROM s""")
def achievement_tiers(t):
    tiers = (("gold", 1500), ("silver", 800), ("bronze", 300))
    m, tier, after = F.col("metric"), None, None
    for name, at in tiers:
        tier = F.when(m >= at, name) if tier is None else tier.when(m >= at, name)
    for (_, at), nxt in zip(tiers, (None, 1500, 800), strict=True):
        after = F.when(m >= at, F.lit(nxt)) if after is None else after.when(m >= at, F.lit(nxt))
    return t.v_messages.groupBy("session_id").agg(F.sum(F.length("content")).alias("metric")).select("session_id", "metric", tier.alias("tier"), after.otherwise(300).alias("next_at"))


@query("SELECT lang AS origin, doc_id AS item FROM documents UNION ALL SELECT 'bench' AS origin, item_id AS item FROM benchmark")
def union_sources(t):
    return t.documents.select(F.col("lang").alias("origin"), F.col("doc_id").alias("item")).unionByName(t.benchmark.select(F.lit("bench").alias("origin"), F.col("item_id").alias("item")))


@query("SELECT conv_id % 3 AS run, array_to_string(list_sort(list(DISTINCT turn)), ',') AS completed FROM conversations GROUP BY 1")
def checkpoint_union(t):
    return t.conversations.groupBy((F.col("conv_id") % 3).alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("turn")), lambda x: x.cast("string")), ",").alias("completed"))


@query("SELECT id, min(k) AS first_turn, coalesce(array_to_string(list_sort(list(DISTINCT tool_name)), ','), '') AS tools FROM (SELECT session_id AS id, turn AS k, tool_name FROM v_messages) GROUP BY id")
def transcript_join(t):
    return t.v_messages.groupBy(F.col("session_id").alias("id")).agg(F.min("turn").alias("first_turn"), F.array_join(F.array_sort(F.collect_set("tool_name")), ",").alias("tools"))
