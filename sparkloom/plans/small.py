"""Small scalar plans: previews, wrappers, extraction, formats and predicates over rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers, writers
from .base import query


@query("""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN strpos(reverse(head), chr(10)) > 0 AND 201 - strpos(reverse(head), chr(10)) > 100 THEN substring(head, 1, 200 - strpos(reverse(head), chr(10))) ELSE head END AS preview
FROM (SELECT doc_id, text, substring(text, 1, 200) AS head FROM documents)""")
def newline_preview(t):
    """Cut at the last line break if that lies past the half."""
    back = F.instr(F.reverse("head"), "\n")
    cut = F.when((back > 0) & (201 - back > 100), F.expr("substring(head, 1, 200 - instr(reverse(head), '\n'))")).otherwise(F.col("head"))
    return t.documents.select("doc_id", "text", F.substring("text", 1, 200).alias("head")).select("doc_id", F.when(F.length("text") <= 200, F.col("text")).otherwise(cut).alias("preview"))


COMMAND = "CASE id % 6 WHEN 0 THEN 'rm -rf build' WHEN 1 THEN 'echo x > out.txt' WHEN 2 THEN 'echo x >> out.txt' WHEN 3 THEN 'git reset --hard' WHEN 4 THEN 'ls -la' ELSE 'truncate -s 0 log' END"


@query(rf"SELECT id, regexp_matches(cmd, '(^|[;&|]\s*)(rm|rmdir|truncate|shred)\s|git\s+(reset\s+--hard|clean\s+-)|(^|[^>])>([^>]|$)') AS destructive FROM (SELECT id, {COMMAND} AS cmd FROM v_messages)")
def destructive_command(t):
    """Deleting commands and overwriting redirections; appending is none."""
    pattern = r"(^|[;&|]\s*)(rm|rmdir|truncate|shred)\s|git\s+(reset\s+--hard|clean\s+-)|(^|[^>])>([^>]|$)"
    return t.v_messages.select("id", F.expr(COMMAND).alias("cmd")).select("id", F.col("cmd").rlike(pattern).alias("destructive"))


@query("SELECT id FROM v_files WHERE NOT list_has_any(string_split(replace(path, '\\', '/'), '/'), ['src1', 'src12'])")
def path_exclusion(t):
    return t.v_files.where(~readers.path_has_segment(F.col("path"), ("src1", "src12"))).select("id")


@query("""SELECT session_id, count(tool_name) > 1 AND count(*) FILTER (WHERE tool_name = 'terminal') = 0 AND count(tool_name) = count(DISTINCT tool_name || CAST(turn AS STRING)) AS parallel FROM v_messages GROUP BY session_id""")
def parallel_safety(t):
    """A batch runs in parallel if it has several calls, none of them exclusive, on targets apart."""
    target = F.concat("tool_name", F.col("turn").cast("string"))
    safe = (F.count("tool_name") > 1) & (F.count_if(F.col("tool_name") == "terminal") == 0) & (F.count("tool_name") == F.countDistinct(target))
    return t.v_messages.groupBy("session_id").agg(safe.alias("parallel"))


PATCH = "concat('*** Begin Patch', chr(10), '*** Update File: src/', source, '.py', chr(10), '+x', chr(10), '*** Add File: doc/', CAST(doc_id AS STRING), '.md', chr(10), '*** End Patch')"


@query(rf"SELECT doc_id, array_to_string(regexp_extract_all({PATCH}, '\*\*\* (?:Update|Add|Delete) File: ([^\n]+)', 1), ',') AS paths FROM documents")
def patch_paths(t):
    patch = F.expr(PATCH.replace("chr(10)", "'\n'"))
    return t.documents.select("doc_id", F.array_join(F.regexp_extract_all(patch, F.lit(r"\*\*\* (?:Update|Add|Delete) File: ([^\n]+)"), F.lit(1)), ",").alias("paths"))


SPEC = "CASE p_partkey % 4 WHEN 0 THEN '@scope/pkg@1.2' WHEN 1 THEN 'pkg@latest' WHEN 2 THEN 'lib[extra]==2.0' ELSE 'plain' END"


@query(rf"""SELECT id, regexp_extract(spec, '^(@[^/]+/[^@]+|[^@\[=]+)', 1) AS name, nullif(nullif(regexp_extract(spec, '(?:[^@]@|==)([^@=]+)$', 1), 'latest'), '') AS version FROM (SELECT p_partkey AS id, {SPEC} AS spec FROM part)""")
def package_spec(t):
    version = F.regexp_extract("spec", r"(?:[^@]@|==)([^@=]+)$", 1)
    rows = t.part.select(F.col("p_partkey").alias("id"), F.expr(SPEC).alias("spec"))
    return rows.select("id", F.regexp_extract("spec", r"^(@[^/]+/[^@]+|[^@\[=]+)", 1).alias("name"), F.when(~version.isin("latest", ""), version).alias("version"))


@query("SELECT id, concat(CAST(age_hours * 60 // 3600 AS STRING), ':', lpad(CAST(age_hours * 60 % 3600 // 60 AS STRING), 2, '0'), ':', lpad(CAST(age_hours * 60 % 60 AS STRING), 2, '0')) AS hms FROM v_files")
def hms_format(t):
    s = F.col("age_hours") * 60
    return t.v_files.select("id", F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60).alias("hms"))


@query("SELECT event_id, coalesce(nullif(event_id % 5, 0), TRY_CAST(nullif(regexp_extract(concat('please retry after ', CAST(event_id % 90 AS STRING), 's'), 'retry after (\\d+)', 1), '') AS BIGINT)) AS wait FROM events")
def retry_after(t):
    """The structured value where there is one, else what the message says."""
    said = F.concat(F.lit("please retry after "), (F.col("event_id") % 90).cast("string"), F.lit("s"))
    return t.events.select("event_id", F.coalesce(F.nullif(F.col("event_id") % 5, F.lit(0)), F.regexp_extract(said, r"retry after (\d+)", 1).try_cast("long")).alias("wait"))


@query("SELECT o_orderkey AS id, CASE WHEN v >= 1000000 THEN concat(CAST(CAST(floor(v / 1000000) AS BIGINT) AS STRING), 'M') WHEN v >= 1000 THEN concat(CAST(CAST(floor(v / 1000) AS BIGINT) AS STRING), 'K') ELSE CAST(CAST(floor(v) AS BIGINT) AS STRING) END AS volume FROM (SELECT o_orderkey, o_totalprice * 10 AS v FROM orders)")
def human_volume(t):
    v = F.col("o_totalprice") * 10
    whole = lambda x: F.floor(x).cast("string")
    return t.orders.select(F.col("o_orderkey").alias("id"), F.when(v >= 1000000, F.concat(whole(v / 1000000), F.lit("M"))).when(v >= 1000, F.concat(whole(v / 1000), F.lit("K"))).otherwise(whole(v)).alias("volume"))


@query("""SELECT id, CASE WHEN role <> 'assistant' OR length(content) < 32 OR content LIKE '<untrusted>%' THEN content ELSE concat('<untrusted>', chr(10), content, chr(10), '</untrusted>') END AS wrapped FROM v_messages""")
def untrusted_wrapper(t):
    c = F.col("content")
    plain = (F.col("role") != "assistant") | (F.length(c) < 32) | c.startswith("<untrusted>")
    return t.v_messages.select("id", F.when(plain, c).otherwise(F.concat(F.lit("<untrusted>\n"), c, F.lit("\n</untrusted>"))).alias("wrapped"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_dig(t):
    return t.events.select("event_id", readers.dig(F.col("props"), "k").cast("long").alias("k"))


@query("SELECT conv_id, turn, role FROM conversations")
def parallel_arrays(t):
    """Arrays side by side back to rows."""
    both = F.array_sort(F.collect_list(F.struct("turn", "role")))
    wide = t.conversations.groupBy("conv_id").agg(both.alias("b")).select("conv_id", F.col("b.turn").alias("turn"), F.col("b.role").alias("role"))
    return readers.parallel_arrays(wide, ["turn", "role"])


LINE = "concat('2024-01-', lpad(CAST(1 + event_id % 28 AS STRING), 2, '0'), ' 10:00:00 ', CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END, CASE WHEN event_id % 2 = 0 THEN ' gateway.run: ' ELSE ' agent.loop: ' END, event_type)"


@query(f"SELECT line FROM (SELECT *, {LINE} AS line FROM events) WHERE event_type <> 'view' AND event_id % 2 = 0 AND 1 + event_id % 28 >= 10")
def log_filter(t):
    lines = t.events.select(F.expr(LINE).alias("value"))
    return readers.log_filter(lines, since="2024-01-10 00:00:00", level="INFO", component="gateway").select(F.col("value").alias("line"))


@query("SELECT concat('| ', CAST(n_nationkey AS STRING), ' | ', n_name, ' |') AS row FROM nation")
def markdown_table(t):
    return t.nation.select(writers.markdown_row(["n_nationkey", "n_name"]).alias("row"))
