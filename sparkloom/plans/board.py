"""Plans over task boards, stores and small operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .base import query


@query("SELECT status, count(*) AS n FROM v_tasks GROUP BY status")
def board_stats(t):
    return t.v_tasks.groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT r.id FROM v_runs r LEFT JOIN v_tasks t ON t.id = r.task_id WHERE t.id IS NULL")
def kanban_orphan_runs(t):
    return t.v_runs.select("id", "task_id").join(t.v_tasks.select(F.col("id").alias("task_id")), "task_id", "left_anti").select("id")


@query("SELECT l.child_id FROM v_links l JOIN v_tasks p ON p.id = l.parent_id GROUP BY l.child_id HAVING sum(CASE WHEN p.status = 'done' THEN 1 ELSE 0 END) = count(*)")
def kanban_ready(t):
    """Tasks all of whose parents are done."""
    parents = t.v_tasks.select(F.col("id").alias("parent_id"), (F.col("status") == "done").alias("done"))
    return t.v_links.join(parents, "parent_id").groupBy("child_id").agg(F.bool_and("done").alias("ok")).where("ok").select("child_id")


@query("SELECT task_id, count(*) AS runs FROM v_runs GROUP BY task_id HAVING count(*) <> 1")
def kanban_run_counts(t):
    return t.v_runs.groupBy("task_id").agg(F.count("*").alias("runs")).where("runs <> 1")


@query("SELECT r.id, l.parent_id FROM v_runs r JOIN v_links l ON l.child_id = r.task_id JOIN v_tasks p ON p.id = l.parent_id WHERE r.started_on < p.created_on")
def claim_before_parent(t):
    links = t.v_links.withColumnRenamed("child_id", "task_id")
    parents = t.v_tasks.select(F.col("id").alias("parent_id"), "created_on")
    return t.v_runs.join(links, "task_id").join(parents, "parent_id").where("started_on < created_on").select("id", "parent_id")


@query("""WITH r AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT id, q.assignee FROM (SELECT o_orderkey AS id, o_custkey AS assignee, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'O') q LEFT JOIN r ON r.o_custkey = q.assignee WHERE rn + coalesce(n, 0) <= 5""")
def dispatch_cap(t):
    """Each assignee, here a customer, gets tasks up to a cap that all those already running count towards."""
    tasks = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("assignee"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    running = tasks.where("status = 'P'").groupBy("assignee").agg(F.count("*").alias("n"))
    w = Window.partitionBy("assignee").orderBy("priority", "id")
    ready = tasks.where("status = 'O'").withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    return ready.join(running, "assignee", "left").where(F.col("rn") + F.coalesce("n", F.lit(0)) <= 5).select("id", "assignee")


@query("""SELECT id, 'stuck' AS issue FROM v_tasks WHERE status = 'running' AND created_on < DATE '1996-06-01' UNION ALL SELECT task_id AS id, 'flapping' AS issue FROM v_runs GROUP BY task_id HAVING count(*) >= 6""")
def task_issues(t):
    stuck = t.v_tasks.where("status = 'running' AND created_on < DATE '1996-06-01'").select("id", F.lit("stuck").alias("issue"))
    flapping = t.v_runs.groupBy(F.col("task_id").alias("id")).agg(F.count("*").alias("n")).where("n >= 6").select("id", F.lit("flapping").alias("issue"))
    return stuck.unionByName(flapping)


@query("SELECT id, CASE WHEN age >= 600 THEN 'critical' WHEN age >= 200 THEN 'high' WHEN age >= 100 THEN 'low' END AS severity FROM (SELECT id, date_diff('day', created_on, DATE '1998-08-01') AS age FROM v_tasks WHERE status = 'ready') WHERE age >= 100")
def stranded_severity(t):
    age = F.datediff(F.lit("1998-08-01").cast("date"), "created_on")
    return t.v_tasks.where("status = 'ready'").select("id", age.alias("age")).where("age >= 100").select("id", F.when(F.col("age") >= 600, "critical").when(F.col("age") >= 200, "high").otherwise("low").alias("severity"))


@query("SELECT id FROM v_tasks WHERE status = 'running' AND created_on < DATE '1997-01-01' AND id % 7 <> 0")
def stale_claims(t):
    return t.v_tasks.where("status = 'running' AND created_on < DATE '1997-01-01' AND id % 7 <> 0").select("id")


@query("SELECT id FROM v_tasks WHERE status <> 'done' AND created_on <= DATE '1995-03-01'")
def due_jobs(t):
    return t.v_tasks.where("status <> 'done' AND created_on <= DATE '1995-03-01'").select("id")


@query("SELECT doc_id % 40 AS key, arg_max(source, doc_id) AS author, arg_max(n_chars, doc_id) AS value FROM documents GROUP BY 1")
def blackboard_latest(t):
    return t.documents.groupBy((F.col("doc_id") % 40).alias("key")).agg(F.max_by("source", "doc_id").alias("author"), F.max_by("n_chars", "doc_id").alias("value"))


@query("SELECT coalesce(a.id, b.id) AS id, coalesce(b.v, a.v) AS v, coalesce(a.made, b.made) AS made FROM (SELECT doc_id AS id, n_chars AS v, 1 AS made FROM documents WHERE doc_id % 3 <> 0) a FULL OUTER JOIN (SELECT doc_id AS id, n_chars + 1 AS v, 2 AS made FROM documents WHERE doc_id % 2 = 0) b ON a.id = b.id")
def upsert_merge(t):
    """New fields win, the first time of making stays."""
    d = t.documents
    old = d.where("doc_id % 3 != 0").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("old_v"), F.lit(1).alias("old_made"))
    new = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), (F.col("n_chars") + 1).alias("new_v"), F.lit(2).alias("new_made"))
    return old.join(new, "id", "full").select("id", F.coalesce("new_v", "old_v").alias("v"), F.coalesce("old_made", "new_made").alias("made"))


@query("SELECT key, min(event_id) AS event_id FROM (SELECT sha256(concat(event_type, ':', props)) AS key, event_id FROM events) WHERE key NOT IN (SELECT sha256(concat(event_type, ':', props)) FROM events WHERE event_id < 500) GROUP BY key")
def receipt_dedup(t):
    """A receipt is taken once: its key is a digest of its content."""
    keyed = t.events.select(F.sha2(F.concat_ws(":", "event_type", "props"), 256).alias("key"), "event_id")
    return keyed.join(keyed.where("event_id < 500").select("key"), "key", "left_anti").groupBy("key").agg(F.min("event_id").alias("event_id"))


@query("SELECT doc_id FROM documents WHERE sha256(CASE WHEN doc_id % 9 = 0 THEN concat(text, '!') ELSE text END) <> sha256(text)")
def hash_integrity(t):
    now = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return t.documents.where(F.sha2(now, 256) != F.sha2("text", 256)).select("doc_id")


@query("SELECT page_id FROM pages WHERE lower(url) LIKE '%casino%' OR lower(html) LIKE '%edhaha%'")
def evidence_keyword(t):
    return t.pages.where(F.lower(F.coalesce("url", F.lit(""))).contains("casino") | F.lower(F.coalesce("html", F.lit(""))).contains("edhaha")).select("page_id")


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, array_to_string(list_sort(list(DISTINCT lang)), ',') AS which FROM documents GROUP BY source")
def evidence_summary(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("which"))


@query("SELECT id FROM v_files WHERE id % 8 <> 0 AND age_hours >= 1200")
def cards_due(t):
    return t.v_files.where("id % 8 != 0 AND age_hours >= 1200").select("id")


@query("SELECT id % 5 AS collection, count(*) AS total, count(*) FILTER (WHERE id % 8 = 0) AS retired, count(*) FILTER (WHERE id % 8 <> 0 AND age_hours >= 1200) AS due FROM v_files GROUP BY 1")
def cards_stats(t):
    due = (F.col("id") % 8 != 0) & (F.col("age_hours") >= 1200)
    return t.v_files.groupBy((F.col("id") % 5).alias("collection")).agg(F.count("*").alias("total"), F.count_if(F.col("id") % 8 == 0).alias("retired"), F.count_if(due).alias("due"))


KEYS = "SELECT source, lang, n_chars % 50 AS rule, max(doc_id) AS id FROM documents WHERE {} GROUP BY ALL"


@query(f"""WITH a AS ({KEYS.format('doc_id % 2 = 0')}), b AS ({KEYS.format('doc_id % 3 = 0')})
SELECT coalesce(a.source, b.source) AS source, coalesce(a.lang, b.lang) AS lang, coalesce(a.rule, b.rule) AS rule, CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'fixed' ELSE 'unchanged' END AS change FROM a FULL OUTER JOIN b USING (source, lang, rule)""")
def snapshot_diff(t):
    """Keys of two snapshots, the last of each key counting: what is new, fixed or unchanged."""
    keys = ["source", "lang", "rule"]
    snap = lambda cond, name: t.documents.where(cond).groupBy("source", "lang", (F.col("n_chars") % 50).alias("rule")).agg(F.max("doc_id").alias(name))
    both = snap("doc_id % 2 = 0", "a").join(snap("doc_id % 3 = 0", "b"), keys, "full")
    return both.select(*keys, F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "fixed").otherwise("unchanged").alias("change"))


@query("SELECT a.k, a.n AS before, b.n AS after, b.n - a.n AS overhead FROM (SELECT o_custkey % 100 AS k, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a JOIN (SELECT o_custkey % 100 AS k, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b USING (k)")
def ab_compare(t):
    """Both runs in one pass over the table."""
    k = F.col("o_custkey") % 100
    both = t.orders.groupBy(k.alias("k")).agg(F.count_if(F.col("o_orderkey") % 2 == 0).alias("before"), F.count_if(F.col("o_orderkey") % 2 == 1).alias("after"))
    return both.where("before > 0 AND after > 0").withColumn("overhead", F.col("after") - F.col("before"))


@query("SELECT DISTINCT o_custkey AS project FROM orders WHERE o_orderkey % 4 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 1)")
def stale_projects(t):
    indexed = t.orders.where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("project")).distinct()
    return indexed.join(t.orders.where("o_orderkey % 4 = 1").select(F.col("o_custkey").alias("project")), "project", "left_anti")


@query("SELECT event_type, user_id % 100 AS k, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedupe_keep_last(t):
    return t.events.groupBy("event_type", (F.col("user_id") % 100).alias("k")).agg(F.max("event_id").alias("event_id"))


MODEL = "SELECT p_partkey AS id, p_size % 4 <> 0 AS tool_call, p_size % 11 = 0 AS deprecated, p_size * 4000 AS context, p_size % 2 = 0 AS reasoning, p_brand = 'Brand#11' AS family, p_retailprice AS cost FROM part"
SCORE = "CASE WHEN NOT tool_call OR deprecated THEN 0.0 ELSE least(1.0, greatest(0.0, 0.2 + CASE WHEN context < 32000 THEN -0.2 WHEN context > 100000 THEN 0.25 WHEN context > 64000 THEN 0.15 ELSE 0 END + CASE WHEN reasoning THEN 0.3 ELSE 0 END + CASE WHEN family THEN 0.2 ELSE 0 END)) END"


def _models(t):
    p = t.part
    rows = p.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4 != 0).alias("tool_call"), (F.col("p_size") % 11 == 0).alias("deprecated"), (F.col("p_size") * 4000).alias("context"), (F.col("p_size") % 2 == 0).alias("reasoning"), (F.col("p_brand") == "Brand#11").alias("family"), F.col("p_retailprice").alias("cost"))
    c = F.col("context")
    part = 0.2 + F.when(c < 32000, -0.2).when(c > 100000, 0.25).when(c > 64000, 0.15).otherwise(0.0) + F.when(F.col("reasoning"), 0.3).otherwise(0.0) + F.when(F.col("family"), 0.2).otherwise(0.0)
    return rows.withColumn("score", F.round(F.when(~F.col("tool_call") | F.col("deprecated"), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), part))), 6))


@query(f"SELECT id, round({SCORE}, 6) AS score FROM ({MODEL})")
def gated_score(t):
    return _models(t).select("id", "score")


@query(f"SELECT id, round({SCORE}, 6) AS score FROM ({MODEL}) ORDER BY 2 DESC, context DESC, cost DESC, id LIMIT 1")
def best_candidate(t):
    return _models(t).orderBy(F.desc("score"), F.desc("context"), F.desc("cost"), "id").select("id", "score").limit(1)


@query("SELECT l_orderkey AS id, arg_max(l_linenumber, CAST(l_linestatus = 'F' AS INTEGER) * 100 + CAST(l_returnflag = 'R' AS INTEGER) * 10 + l_linenumber) AS artifact FROM lineitem GROUP BY 1")
def preferred_artifact(t):
    rank = F.struct(F.col("l_linestatus") == "F", F.col("l_returnflag") == "R", "l_linenumber")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.max_by("l_linenumber", rank).alias("artifact"))


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id < 1000 AND s.user_id = e.user_id AND s.event_type = e.event_type)) WHERE rn <= 5")
def register_capped(t):
    """What is new by key, up to a cap of pending ones."""
    seen = t.events.where("event_id < 1000").select("user_id", "event_type")
    w = Window.partitionBy("event_type").orderBy("event_id")
    return t.events.join(seen, ["user_id", "event_type"], "left_anti").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("event_id", "event_type")


@query("SELECT e.event_id FROM events e JOIN (SELECT user_id, max(event_id) AS w FROM events WHERE event_type = 'purchase' GROUP BY 1) p ON p.user_id = e.user_id WHERE e.event_type = 'view' AND p.w > e.event_id")
def stale_write(t):
    """Reads that a later write of the same key has overtaken."""
    writes = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("w"))
    return t.events.where("event_type = 'view'").join(writes, "user_id").where("w > event_id").select("event_id")


@query("SELECT user_id, count(*) AS writes, array_to_string(list_sort(list(event_id)), ',') AS ids FROM events WHERE event_id >= 9000 AND event_type = 'purchase' AND user_id <> 5 GROUP BY 1")
def writes_since(t):
    w = t.events.where("event_id >= 9000 AND event_type = 'purchase' AND user_id != 5")
    return w.groupBy("user_id").agg(F.count("*").alias("writes"), F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT id FROM (SELECT id, status, row_number() OVER (PARTITION BY status = 'done' ORDER BY created_on DESC, id) AS rn FROM v_tasks) WHERE status <> 'done' OR rn <= 100")
def retain_newest(t):
    done = t.v_tasks.where("status = 'done'").orderBy(F.desc("created_on"), "id").select("id").limit(100)
    return t.v_tasks.where("status != 'done'").select("id").unionByName(done)


RULES = ("casino", "pills", "track")


@query("SELECT page_id, rule FROM pages, (SELECT unnest(['casino', 'pills', 'track']) AS rule) WHERE contains(url, rule) OR contains(html, concat(rule, '('))")
def rule_scan(t):
    """One hit for each rule at most; the rules are a stated few, so they go to the row."""
    hit = lambda r: F.col("url").contains(r) | F.col("html").contains(r + "(")
    found = F.array_compact(F.array(*[F.when(hit(r), F.lit(r)) for r in RULES]))
    return t.pages.select("page_id", F.explode(found).alias("rule"))


BLOCKED = ("casino-win.example.net", "spam-farm.example.org", "cheap-pills.example.com")


@query("""SELECT page_id, host, CASE WHEN host IS NULL OR host = '' THEN FALSE ELSE bool_or(coalesce(host = rule OR ends_with(host, concat('.', rule)), FALSE)) END AS blocked
FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages), (SELECT unnest(['casino-win.example.net', 'spam-farm.example.org', 'cheap-pills.example.com']) AS rule) GROUP BY page_id, host""")
def url_blocklist(t):
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    blocked = F.lit(False)
    for rule in BLOCKED:
        blocked = blocked | (F.col("host") == rule) | F.col("host").endswith("." + rule)
    return t.pages.select("page_id", host.alias("host")).select("page_id", "host", F.coalesce((F.col("host") != "") & blocked, F.lit(False)).alias("blocked"))
