"""Registry of queries with their SQL for the cross-check; the views of the data model in that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return put


PF = """pf AS (SELECT vec_id, vec_id // 20 AS image_id, (vec_id % 20) // 5 AS row, vec_id % 5 AS col, list_transform(embedding, lambda x: x::DOUBLE) AS features,
 greatest(label - 5, 0) AS class_id, label >= 6 AS is_defect, CASE WHEN (vec_id // 20) % 5 = 0 THEN 'query' WHEN (vec_id // 20) % 5 IN (1, 2) AND label < 6 THEN 'clean'
 WHEN (vec_id // 20) % 5 IN (3, 4) THEN 'candidate' ELSE 'unused' END AS role FROM embeddings)"""
PS = """ps AS (SELECT l_orderkey AS image_id, round(l_quantity / 50.0 + 0.3 * (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * l_discount * 10, 6) AS score, l_returnflag = 'R' AS is_defect,
 CASE WHEN l_returnflag = 'R' THEN l_linenumber % 4 + 1 ELSE 0 END AS class_id, l_linestatus = 'O' AS valid FROM lineitem)"""
EV = """ev AS (SELECT user_id AS image_id, event_id, (rn - 1) // 8 AS row, (rn - 1) % 8 AS col, value AS score, event_type = 'error' AS is_defect
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events))"""
RUNS = """runs AS (SELECT l_returnflag AS condition, l_linenumber AS seed, 0 AS fold, round(avg(l_discount), 6) AS auprc, round(avg(l_tax), 6) AS auroc FROM lineitem GROUP BY ALL)"""
DIST = "1 - list_inner_product(q.features, b.features) / (greatest(sqrt(list_inner_product(q.features, q.features)), 1e-12) * greatest(sqrt(list_inner_product(b.features, b.features)), 1e-12))"
L2 = "sqrt(list_sum(list_transform(list_zip(q.features, b.features), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
#: Candidates with their distance to the clean bank, rounded so that both engines rank alike.
CAND = f"cand AS (SELECT q.vec_id AS id, q.image_id, q.row, q.col, q.class_id, q.is_defect, round(min({DIST}), 6) AS score FROM pf q, pf b WHERE q.role = 'candidate' AND b.role = 'clean' GROUP BY ALL)"


def rank_sql(ns: str, seed: int, ident: str) -> str:
    return f"sha256('{ns}' || chr(0) || '{seed}' || chr(0) || {ident}::VARCHAR)"


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)
