"""Graphs over units: dependencies, PageRank, headings, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs
from .registry import fixture, query, table, values

EDGES = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 1), (6, 2), (7, 8), (8, 7), (9, 9)]
SEEDS = [(1,), (7,)]
LEVELS = [(1, 4), (2, 1), (3, 0), (4, 0), (5, 2), (6, 3), (7, 0), (8, 1), (9, 0)]
HEADINGS = [(1, 1, 1), (1, 2, 0), (1, 3, 2), (1, 4, 0), (1, 5, 3), (1, 6, 0), (1, 7, 2), (1, 8, 0), (1, 9, 1), (1, 10, 3), (1, 11, 0), (2, 1, 0), (2, 2, 2), (2, 3, 0)]
TREE = [(1, None, True, True), (2, 1, True, True), (3, 2, False, True), (4, 1, True, True), (5, 4, False, False), (6, None, True, True), (7, 6, True, True)]
_E, _S, _LV, _HD = (f"(SELECT * FROM ({values(r)}) t({c}))" for r, c in ((EDGES, "src, dst"), (SEEDS, "uid"), (LEVELS, "uid, level"), (HEADINGS, "doc, ord, level")))


def _edges(spark: SparkSession) -> DataFrame:
    return fixture(spark, EDGES, "src long, dst long")


@query("adjacency", """WITH u AS (SELECT conv_id AS doc, conv_id * 1000 + turn AS uid, turn AS ord FROM conversations), a AS (SELECT uid, d, lead(uid, d) OVER (PARTITION BY doc, d ORDER BY ord) AS nxt FROM u, (SELECT unnest([1, 2, 3]) AS d)), o AS (SELECT uid AS src, nxt AS dst, round(0.45::DOUBLE * exp(-d / 3.0::DOUBLE), 9) AS weight FROM a WHERE nxt IS NOT NULL)
SELECT * FROM o UNION ALL SELECT dst, src, weight FROM o""")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), (F.col("conv_id") * 1000 + F.col("turn")).alias("uid"), F.col("turn").alias("ord"))
    return graphs.adjacency(units).withColumn("weight", F.round("weight", 9))


@query("refers_chain", """WITH s AS (SELECT DISTINCT item_id AS uid, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS name FROM benchmark), n AS (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM s), l AS (SELECT uid AS src, lead(uid) OVER (PARTITION BY name ORDER BY uid) AS dst FROM n WHERE n BETWEEN 2 AND 24) SELECT src, dst, round(sum(0.6::DOUBLE), 6) AS weight FROM l WHERE dst IS NOT NULL GROUP BY src, dst""")
def refers_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("uid"), F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("name"))
    return graphs.refers(symbols).withColumn("weight", F.round("weight", 6))


@query("closure", f"WITH RECURSIVE c(uid, depth) AS (SELECT uid, 0::BIGINT FROM {_S} UNION SELECT e.dst, c.depth + 1 FROM c JOIN {_E} e ON e.src = c.uid WHERE c.depth < 3) SELECT uid, min(depth) AS depth FROM c GROUP BY uid")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.closure(fixture(spark, SEEDS, "uid long"), _edges(spark))


@query("closure_violations", f"SELECT src, dst FROM {_E} WHERE src IN (SELECT uid FROM {_S}) AND dst NOT IN (SELECT uid FROM {_S})")
def closure_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.violations(fixture(spark, SEEDS, "uid long"), _edges(spark))


def _push(name: str, source: str) -> str:
    return f"{name} AS (SELECT l.uid, greatest(l.level, coalesce(p.pushed, 0)) AS level FROM {source} l LEFT JOIN (SELECT e.dst, max(level) - 1 AS pushed FROM {_E} e JOIN {source} s ON e.src = s.uid GROUP BY e.dst) p ON p.dst = l.uid)"


@query("propagate", f"WITH p0 AS (SELECT * FROM {_LV}), {_push('p1', 'p0')}, {_push('p2', 'p1')}, {_push('p3', 'p2')} SELECT uid, level FROM p3")
def propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.propagate(fixture(spark, LEVELS, "uid long, level long"), _edges(spark))


def _step(name: str, source: str) -> str:
    return f"{name} AS (SELECT b.uid, b.p, 0.85::DOUBLE * (coalesce(g.gain, 0) + (1 - (SELECT coalesce(sum(r), 0) FROM {source} WHERE uid IN (SELECT src FROM o))) * b.p) + 0.15::DOUBLE * b.p AS r FROM {source} b LEFT JOIN (SELECT m.dst, sum(m.share * s.r) AS gain FROM m JOIN {source} s ON m.src = s.uid GROUP BY m.dst) g ON g.dst = b.uid)"


@query("pagerank_k3", f"WITH u AS (SELECT unnest(range(1, 11)) AS uid), e AS (SELECT src, dst, 1.0::DOUBLE + src * 0.1::DOUBLE AS weight FROM {_E}), o AS (SELECT src, sum(weight) AS out FROM e GROUP BY src), m AS (SELECT e.src, dst, weight / out AS share FROM e JOIN o USING (src)), b AS (SELECT uid, uid / sum(uid) OVER () AS p FROM u), r0 AS (SELECT uid, p, p AS r FROM b), {_step('r1', 'r0')}, {_step('r2', 'r1')}, {_step('r3', 'r2')} SELECT uid, round(r, 9) AS r FROM r3")
def pagerank_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = fixture(spark, [(i,) for i in range(1, 11)], "uid long")
    edges = _edges(spark).withColumn("weight", 1.0 + F.col("src") * 0.1)
    return graphs.pagerank(units, edges, units.withColumn("p", F.col("uid").cast("double")), 3).withColumn("r", F.round("r", 9))


@query("heading_parents", f"SELECT h.doc, h.ord, h.level, (SELECT max(g.ord) FROM {_HD} g WHERE g.doc = h.doc AND g.ord < h.ord AND g.level > 0 AND (h.level = 0 OR g.level < h.level) AND NOT EXISTS (SELECT 1 FROM {_HD} x WHERE x.doc = h.doc AND x.ord > g.ord AND x.ord < h.ord AND x.level > 0 AND x.level < g.level)) AS parent FROM {_HD} h")
def heading_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.heading_parents(fixture(spark, HEADINGS, "doc long, ord long, level long"))


@query("section_root", f"WITH RECURSIVE t AS (SELECT * FROM ({values(TREE)}) t(uid, parent, heading, live)), c(uid, root) AS (SELECT uid, uid FROM t WHERE parent IS NULL UNION ALL SELECT t.uid, c.root FROM t JOIN c ON t.parent = c.uid) SELECT uid, root FROM c")
def section_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.section_root(fixture(spark, TREE, "uid long, parent long, heading boolean, live boolean").select("uid", "parent"))


@query("orphan_headings", f"WITH RECURSIVE t AS (SELECT * FROM ({values(TREE)}) t(uid, parent, heading, live)), c(uid, anc) AS (SELECT uid, parent FROM t WHERE parent IS NOT NULL UNION SELECT c.uid, t.parent FROM c JOIN t ON t.uid = c.anc WHERE t.parent IS NOT NULL) SELECT uid FROM t WHERE live AND heading AND uid NOT IN (SELECT anc FROM c JOIN t USING (uid) WHERE t.live AND NOT t.heading)")
def orphan_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = fixture(spark, TREE, "uid long, parent long, heading boolean, live boolean")
    return graphs.orphans(units, units)


@query("edge_layout", "WITH r AS (SELECT source AS doc, doc_id AS uid, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc, uid, CAST(CASE WHEN r % 2 = 1 THEN (r + 1) // 2 ELSE n + 1 - r // 2 END AS BIGINT) AS place FROM r")
def edge_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.edge_layout(table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("uid"), F.col("n_chars").alias("value")))
