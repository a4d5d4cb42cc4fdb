"""Views of the test tables that stand for the tables of a queue and its store.

Each is one SQL text for both engines, but for names of functions; DIALECT turns Spark's into DuckDB's.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TASK = """
SELECT o_orderkey AS task_id, 6 - CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority, o_custkey % 7 AS scheduling_key,
       o_orderkey AS pending_order, o_orderkey % 50 = 0 AS control, o_orderkey % 3 * 1000 AS estimated_bytes,
       CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'leased' ELSE 'completed' END AS state
FROM orders
"""
RECORD = """
SELECT l_orderkey AS pub, CAST(ordinal AS BIGINT) AS ordinal, concat(CAST(l_orderkey AS STRING), '-', CAST(ordinal AS STRING)) AS record_id,
       CAST(l_quantity AS BIGINT) * 1024 AS bytes, CAST(l_quantity AS BIGINT) AS tokens,
       CASE WHEN l_returnflag = 'R' THEN 'tensor.v1' ELSE 'bytes.v1' END AS codec
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS ordinal FROM lineitem) AS x
"""
USAGE = "SELECT pub, count(*) AS records, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(tokens) AS BIGINT) AS tokens FROM record GROUP BY pub"
#: Accepted results, before they are numbered in the order of (o_orderdate, task_id).
ACCEPTED = """
SELECT o_orderdate, o_orderkey AS task_id, concat('s-', CAST(o_orderkey AS STRING)) AS submission_id, o_custkey % 16 AS worker,
       coalesce(records, 0) AS records, coalesce(bytes, 0) AS bytes, coalesce(tokens, 0) AS tokens
FROM orders LEFT JOIN record_usage ON pub = o_orderkey WHERE o_orderstatus = 'F'
"""
_WAL = [
    (0, "Submitted", "TRUE"),
    (1, "Leased", "o_orderstatus IN ('P', 'F')"),
    (2, "Failed", "o_orderstatus IN ('P', 'F') AND o_custkey % 5 = 0"),
    (3, "Leased", "o_orderstatus IN ('P', 'F') AND o_custkey % 5 = 0"),
    (4, "Yielded", "o_orderstatus IN ('P', 'F') AND o_custkey % 11 = 0"),
    (5, "Leased", "o_orderstatus IN ('P', 'F') AND o_custkey % 11 = 0 AND o_custkey % 2 = 0"),
    (6, "Completed", "o_orderstatus = 'F' AND NOT (o_custkey % 11 = 0 AND o_custkey % 2 = 1)"),
]
WAL = " UNION ALL ".join(
    f"SELECT o_orderkey AS seq, {i} AS idx, '{kind}' AS type, o_orderkey AS task_id, TRUE AS retryable, 3 AS max_attempts, o_custkey % 16 + {i} AS worker FROM orders WHERE {test}"
    for i, kind, test in _WAL
)
TRACE = """
SELECT event_id, CASE event_type WHEN 'purchase' THEN 'write' WHEN 'view' THEN 'read' ELSE 'read_range' END AS op,
       CAST(round(value * 1000) AS BIGINT) AS bytes, unix_seconds(CAST(ts AS TIMESTAMP)) AS second,
       CASE WHEN event_id % 997 <> 0 OR event_type <> 'view' THEN CAST(round(value * 1000) AS BIGINT) END AS checked_bytes
FROM events WHERE event_type IN ('purchase', 'view', 'click')
"""
EDGE = """
SELECT doc_id AS parent, doc_id div 2 AS child FROM documents WHERE doc_id > 0
UNION SELECT doc_id, doc_id - 7 FROM documents WHERE doc_id % 5 = 0 AND doc_id >= 7
"""
PLACE = "SELECT doc_id AS node, doc_id div 8 AS pack FROM documents"
PACK = "SELECT pack, pack % 3 <> 0 AS sealed, pack % 16 = 15 AS tombstoned, size FROM (SELECT doc_id div 8 AS pack, sum(n_chars) AS size FROM documents GROUP BY doc_id div 8) AS x"
#: Every customer; their roots lie in the lower half of the documents, whose ids are 0 and up without gaps, so that
#: what only the upper half reaches can be collected.
OWNER = """
SELECT concat(CASE c_custkey % 4 WHEN 0 THEN 'queue' WHEN 1 THEN 'checkpoint' WHEN 2 THEN 'reader' ELSE 'staged' END, ':', CAST(c_custkey AS STRING)) AS owner,
       c_custkey, doc_id AS root
FROM customer CROSS JOIN (SELECT count(*) AS n FROM documents) AS d JOIN documents ON doc_id = c_custkey % n div 2
"""
PROGRESS = "SELECT conv_id AS task_id, turn AS generation, concat('ref-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS input_ref, turn % 2 = 1 AS acknowledged FROM conversations"
BLOB = "SELECT doc_id, text, doc_id % 8 AS writer FROM documents"

VIEWS = {
    "task": TASK, "record": RECORD, "record_usage": USAGE, "accepted": ACCEPTED, "wal": WAL, "trace": TRACE, "edge": EDGE,
    "place": PLACE, "pack": PACK, "owner": OWNER, "progress": PROGRESS, "blob": BLOB,
}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_FROM = re.compile(r"\b(FROM|JOIN) (\w+)\b")
_USES = {k: sorted({w for _, w in _FROM.findall(v) if w in _TABLES or w in VIEWS}) for k, v in VIEWS.items()}


def dialect(sql: str) -> str:
    """DuckDB's words for Spark's."""
    sql = re.sub(r"\bdiv\b", "//", sql).replace("AS STRING", "AS VARCHAR").replace("AS BINARY", "AS BLOB")
    return re.sub(r"unix_seconds\(CAST\((\w+) AS TIMESTAMP\)\)", r"(epoch_us(\1) // 1000000)", sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, or a table, as a DataFrame."""
    if name in _TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(_FROM.sub(lambda m: f"{m[1]} {{{m[2]}}} AS {m[2]}" if m[2] in _TABLES or m[2] in VIEWS else m[0], VIEWS[name]), **{u: view(spark, sf_dir, u) for u in _USES[name]})


def with_views(sql: str) -> str:
    """DuckDB SQL over the fixtures that a query names."""
    need: list[str] = []

    def add(text: str) -> None:
        for _, w in _FROM.findall(text):
            if w in VIEWS and w not in need:
                add(VIEWS[w])
                if w not in need:
                    need.append(w)

    add(sql)
    own = ", ".join(f"{n} AS ({dialect(VIEWS[n])})" for n in need)
    sql = dialect(sql).strip()
    recursive = "RECURSIVE " if sql.startswith("WITH RECURSIVE") else ""
    if sql.startswith("WITH"):
        return f"WITH {recursive}{own}, " + sql.removeprefix("WITH RECURSIVE ").removeprefix("WITH ") if own else sql
    return f"WITH {own} {sql}" if own else sql
