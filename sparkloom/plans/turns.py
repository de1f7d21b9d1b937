"""Plans of training turns, batches of texts, and checks of files and writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, trajectories
from ..operators import sessions as ops
from ..streaming import operators as streams
from .base import query

# A tool's results follow its call in the turns of every fourth session; some are JSON and some of the arguments aren't.
CALLED = """SELECT session_id, turn, CASE WHEN session_id % 4 = 0 AND turn % 4 IN (2, 3) THEN 'tool' ELSE role END AS role,
  CASE WHEN session_id % 8 = 0 AND turn % 4 = 2 THEN concat('{"size": ', CAST(length(content) AS STRING), '}') WHEN turn % 7 = 1 THEN concat('<REASONING_SCRATCHPAD>weigh</REASONING_SCRATCHPAD>', content) ELSE content END AS content,
  CASE WHEN turn % 3 = 1 THEN concat('step ', CAST(turn AS STRING)) END AS reasoning, concat('call_', CAST(id AS STRING)) AS tool_call_id, tool_name,
  CASE WHEN turn % 2 = 1 THEN concat('{"k": "', CAST(turn AS STRING), '"}') ELSE content END AS arguments FROM v_messages"""


@query(rf"""WITH m AS ({CALLED}), g AS (SELECT *, sum(CASE WHEN role <> 'tool' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn) AS grp FROM m),
p AS (SELECT *, sum(CASE WHEN role = 'tool' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, grp ORDER BY turn) AS nth, max(CASE WHEN role <> 'tool' THEN coalesce(tool_name, '') END) OVER (PARTITION BY session_id, grp) AS head FROM g),
s AS (SELECT *, replace(replace(content, '<REASONING_SCRATCHPAD>', '<think>'), '</REASONING_SCRATCHPAD>', '</think>') AS said FROM p),
o AS (SELECT *, concat(CASE WHEN reasoning IS NOT NULL THEN concat('<think>', chr(10), reasoning, chr(10), '</think>', chr(10)) WHEN said NOT LIKE '%<think>%' THEN concat('<think>', chr(10), '</think>', chr(10)) ELSE '' END, said) AS own FROM s),
v AS (SELECT *, CASE WHEN role = 'tool' THEN concat('<tool_response>', chr(10), '{{"tool_call_id": "', tool_call_id, '", "name": "', CASE WHEN nth <= 2 AND head <> '' THEN head ELSE 'unknown' END, '", "content": ', CASE WHEN content LIKE '{{"size"%' THEN content ELSE CAST(to_json(content) AS VARCHAR) END, '}}', chr(10), '</tool_response>')
  WHEN role <> 'assistant' THEN content WHEN tool_name IS NULL THEN own
  ELSE concat(rtrim(own, concat(' ', chr(9), chr(10), chr(13))), chr(10), '<tool_call>', chr(10), '{{"name": "', tool_name, '", "arguments": ', CASE WHEN turn % 2 = 1 THEN arguments ELSE '{{}}' END, '}}', chr(10), '</tool_call>', chr(10), '<tool_call>', chr(10), '{{"name": "', tool_name, '", "arguments": {{}}}}', chr(10), '</tool_call>') END AS value FROM o)
SELECT session_id, CAST(grp * 2 + CASE WHEN role = 'tool' THEN 1 ELSE 0 END AS BIGINT) AS place, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS "from", string_agg(value, chr(10) ORDER BY turn) AS value FROM v GROUP BY session_id, grp, role""")
def training_turns(t):
    """Every message with a tool calls it twice, the second time without arguments."""
    rows = t._spark.sql(CALLED.replace("{", "{{").replace("}", "}}").replace("v_messages", "{m}"), m=t.v_messages)
    call = lambda arguments: F.struct(F.concat("tool_call_id", F.lit("x")).alias("id"), F.col("tool_name").alias("name"), arguments.alias("arguments"))
    calls = F.when(F.col("tool_name").isNotNull(), F.array(call(F.col("arguments")), call(F.lit("none"))))
    return trajectories.training_turns(rows.withColumn("tool_calls", calls))


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS rn FROM v_messages WHERE session_id = 11), a AS (SELECT rn FROM s WHERE id = 11002)
SELECT s.id, role FROM s, a WHERE abs(s.rn - a.rn) <= 3 AND (role IN ('user') OR id = 11002)""")
def anchored_roles(t):
    """A frame with messages of one role, and its anchor whatever its role."""
    return trajectories.anchored_roles(ops.around(t.v_messages, 11002, 3), 11002, ("user",)).select("id", "role")


@query("""WITH g AS (SELECT session_id, ts, id, content, ts + CASE WHEN length(content) >= 900 THEN 200 WHEN length(content) <= 100 THEN 45 WHEN length(content) <= 300 THEN 61 ELSE 90 END AS ends FROM v_messages WHERE turn % 3 <> 1),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, id) AS s FROM (SELECT *, CASE WHEN ts >= coalesce(max(ends) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ts) THEN 1 ELSE 0 END AS fresh FROM g))
SELECT session_id, min(ts) AS start, count(*) AS n, string_agg(content, chr(10) ORDER BY ts, id) AS merged FROM b GROUP BY session_id, s""")
def quiet_batches(t):
    """Messages sent one after the other as one text, by a wait that goes by the length of each."""
    rows = t.v_messages.where("turn % 3 != 1").select("session_id", F.timestamp_seconds("ts").alias("ts"), "id", F.col("content").alias("text"))
    gap = streams.quiet_gap(F.length("text"), 90, ((100, 45), (300, 61)), 900, 200)
    return streams.text_batches(rows, "session_id", gap).select("session_id", F.unix_timestamp("start").alias("start"), "n", "merged")


LOG = """SELECT event_id AS id, ts, event_id % 4 AS task, user_id AS path, CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' ELSE 'read' END AS kind,
  CASE WHEN event_id % 29 <> 0 THEN event_id // 400 END AS modified, event_id % 5 = 0 AS partial FROM events"""


@query(f"""WITH log AS ({LOG}), w AS (SELECT *, arg_max(task, (ts, id)) FILTER (WHERE kind = 'write') OVER p AS w_task, max((ts, id)) FILTER (WHERE kind = 'write') OVER p AS w_at,
  max((ts, id)) OVER q AS s_at, lag(modified) OVER r AS s_modified, lag(kind = 'read' AND partial) OVER r AS s_partial FROM log
  WINDOW p AS (PARTITION BY path ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY path, task ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (PARTITION BY path, task ORDER BY ts, id))
SELECT id, task, path, CASE WHEN (s_at IS NULL AND w_at IS NULL) OR modified IS NULL THEN NULL WHEN w_task <> task AND s_at IS NULL THEN 'sibling_unread' WHEN w_task <> task AND w_at > s_at THEN 'sibling'
  WHEN s_at IS NOT NULL AND s_modified IS DISTINCT FROM modified THEN 'drifted' WHEN s_partial THEN 'partial' WHEN s_at IS NULL THEN 'unread' END AS stale FROM w WHERE kind = 'write'""")
def stale_write_cases(t):
    return checks.stale_writes(t._spark.sql(LOG.replace("event_id // 400", "event_id DIV 400").replace("FROM events", "FROM {e}"), e=t.events).withColumnRenamed("ts", "at"))


RULES = [
    checks.Rule("source_path", only_path=r"^/src1/"),
    checks.Rule("python_then", scope=r"\.py$", substrings=("then ",), regex=r"\bof\b\W+\bthe\b"),
    checks.Rule("not_notes", beyond=r"\.md$", substrings=("antion", "thing")),
    checks.Rule("digits", regex=r"[0-9]{3,}"),
]


@query(r"""WITH f AS (SELECT id, path, text FROM v_files WHERE text <> '' AND octet_length(encode(text)) <= 262144)
SELECT id, 'source_path' AS rule FROM f WHERE starts_with(path, '/src1/')
UNION ALL SELECT id, 'python_then' FROM f WHERE path LIKE '%.py' AND (contains(text, 'then ') OR regexp_matches(text, '\bof\b\W+\bthe\b'))
UNION ALL SELECT id, 'not_notes' FROM f WHERE path NOT LIKE '%.md' AND (contains(text, 'antion') OR contains(text, 'thing'))
UNION ALL SELECT id, 'digits' FROM f WHERE regexp_matches(text, '[0-9]{3,}')""")
def scoped_rules(t):
    """Rules on paths, on contents of files under a scope of paths, and with exceptions; each once a file."""
    return checks.scanned(t.v_files.select("id", "path", F.col("text").alias("content")), RULES)
