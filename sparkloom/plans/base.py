"""Tables, derived views and the registry that the plans fill.

The fixtures are no session store, so sessions, messages, tasks and the like are derived from
them. The derivations are written once, in SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_sessions": """
        SELECT conv_id AS id,
          CASE conv_id % 4 WHEN 0 THEN 'cli' WHEN 1 THEN 'telegram' WHEN 2 THEN 'tool' ELSE 'cron' END AS source,
          CASE conv_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' END AS model,
          CASE WHEN conv_id % 5 <> 0 THEN conv_id - 1 END AS parent_session_id,
          1704067200 + conv_id * 3600 AS started_at,
          CASE WHEN conv_id % 7 <> 0 THEN 1704067200 + conv_id * 3600 + 1800 END AS ended_at,
          CASE WHEN conv_id % 6 <> 0 THEN concat('Session #', CAST(conv_id AS STRING)) END AS title,
          CAST(floor(sum(CASE WHEN role <> 'assistant' THEN length(text) ELSE 0 END) / 4.0) AS BIGINT) AS input_tokens,
          CAST(floor(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) / 4.0) AS BIGINT) AS output_tokens
        FROM conversations GROUP BY conv_id""",
    "v_messages": """
        SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, turn, role, text AS content,
          1704067200 + conv_id * 3600 + turn * 60 AS ts,
          CASE WHEN role = 'assistant' THEN CASE (conv_id + turn) % 4 WHEN 0 THEN 'read_file' WHEN 1 THEN 'terminal' WHEN 2 THEN 'web_search' END END AS tool_name,
          (conv_id * 7 + turn) % 5 = 0 AS failed,
          CASE WHEN role = 'assistant' AND conv_id % 3 <> 0 THEN concat('<think>plan ', CAST(turn AS STRING), '</think>', text) ELSE text END AS marked
        FROM conversations""",
    "v_left": "SELECT p_partkey AS row_id, concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ', LLC' WHEN 2 THEN ' Holdings' ELSE '' END) AS name FROM part WHERE p_partkey % 8 < 4",
    "v_right": "SELECT p_partkey AS row_id, concat(CASE WHEN p_partkey % 5 = 0 THEN concat(p_name, ' works') WHEN p_partkey % 5 = 1 THEN upper(p_name) ELSE p_name END, CASE p_partkey % 3 WHEN 0 THEN ' CORP' ELSE ' Co' END) AS name FROM part WHERE p_partkey % 8 >= 4",
    "v_tasks": """
        SELECT o_orderkey AS id, concat('user', CAST(o_custkey % 7 AS STRING)) AS assignee,
          CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'ready' ELSE 'running' END AS status, o_orderpriority AS priority,
          CAST(o_orderdate AS DATE) AS created_on
        FROM orders""",
    "v_runs": "SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_orderkey % 97 = 0 THEN -l_orderkey ELSE l_orderkey END AS task_id, l_linestatus AS status, CAST(l_shipdate AS DATE) AS started_on FROM lineitem",
    "v_links": "SELECT DISTINCT l_orderkey - 1 AS parent_id, l_orderkey AS child_id FROM lineitem WHERE l_orderkey % 3 = 0",
    "v_files": """
        SELECT doc_id AS id, concat('/', source, '/doc_', CAST(doc_id AS STRING), CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.md' WHEN 'de' THEN '.json' ELSE '.bin' END) AS path,
          text, n_chars AS size, (doc_id * 37) % 2000 AS age_hours, doc_id % 11 AS accesses, doc_id % 600 AS commits,
          CASE WHEN doc_id % 10 = 0 THEN 3.0 ELSE 1.0 END AS boost
        FROM documents""",
}


class Tables:
    """The tables of a folder and the views derived from them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        if name in VIEWS:
            sql = VIEWS[name]
            used = {t: getattr(self, t) for t in (*TABLES, *VIEWS) if re.search(rf"(FROM|JOIN)\s+{t}\b", sql)}
            for t in used:
                sql = re.sub(rf"(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", sql)
            return self._spark.sql(sql, **used)
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """The statement with the views it names ahead of it."""
    names: list[str] = []

    def need(text: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in names:
                need(VIEWS[v])
                names.append(v)

    need(sql)
    if not names:
        return sql
    heads = ", ".join(f"{v} AS ({VIEWS[v]})" for v in names)
    lead = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH {lead[1] or ''}{heads}, {sql[lead.end():]}" if lead else f"WITH {heads} {sql}"


def query(sql: str | None = None, name: str | None = None):
    """Register a plan over ``Tables`` under its name, with the SQL for the same rows."""

    def wrap(plan):
        key = name or plan.__name__
        QUERIES[key] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = with_views(sql)
        return plan

    return wrap
