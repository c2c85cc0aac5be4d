"""Aggregates: term statistics, profiles, JSON, logs, benchmark summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lexicon
from ..operators import profile, terms
from .registry import fixture, query, table, values
from .text import _COST, _PIECES, _TERMS

_TF = f"tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY doc_id, term)"
_IDF = f"{_TF}, n AS (SELECT count(DISTINCT doc_id) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), idf AS (SELECT term, df, n, greatest(0.05::DOUBLE, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)) AS idf FROM df, n)"
_VEC = f"{_IDF}, w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)), vec AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("term_df", f"WITH {_IDF} SELECT term, CAST(df AS BIGINT) AS df FROM df")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.document_frequency(_docs(spark, sf_dir))


@query("idf", f"WITH {_IDF} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM idf")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.idf(_docs(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


@query("concept_weights", f"WITH {_VEC} SELECT doc_id, term, round(w, 6) AS w FROM vec")
def concept_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.vectors(_docs(spark, sf_dir)).select("doc_id", "term", F.round("w", 6).alias("w"))


@query("top_terms", f"WITH {_IDF} SELECT term, round(idf, 6) AS idf FROM idf ORDER BY df, term LIMIT 50")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.idf(_docs(spark, sf_dir)).orderBy("df", "term").limit(50).select("term", F.round("idf", 6).alias("idf"))


@query("generic_share", f"WITH {_IDF} SELECT doc_id, round(avg(CASE WHEN df > n / 2.0::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS generic FROM tf JOIN idf USING (term) GROUP BY doc_id")
def generic_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.generic_share(_docs(spark, sf_dir)).select("doc_id", F.round("generic", 6).alias("generic"))


@query("information_density", f"""WITH {_VEC}, p AS (SELECT doc_id, w, w / sum(w) OVER (PARTITION BY doc_id) AS p FROM vec), a AS (SELECT doc_id, sum(w) AS s, -sum(p * ln(p)) AS h, count(*) AS k FROM p GROUP BY doc_id),
t AS (SELECT doc_id, CAST(sum({_COST}) AS BIGINT) AS tokens FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_PIECES}')) AS p FROM documents) GROUP BY doc_id)
SELECT doc_id, round(s * (1 + 0.55::DOUBLE * CASE WHEN k > 1 THEN h / ln(k) ELSE 0 END) / pow(greatest(1, tokens), 0.35::DOUBLE), 6) AS density FROM a JOIN t USING (doc_id)""")
def information_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.information_density(_docs(spark, sf_dir)).select("doc_id", F.round("density", 6).alias("density"))


@query("self_information", "WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM documents) GROUP BY word) SELECT word, CAST(n AS BIGINT) AS n, round(-ln(n / sum(n) OVER ()), 6) AS information FROM w")
def self_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.self_information(_docs(spark, sf_dir)).select("word", "n", F.round("information", 6).alias("information"))


@query("type_entropy", "WITH c AS (SELECT source, lang, sum(length(text)) AS m FROM documents GROUP BY source, lang), p AS (SELECT source, m / sum(m) OVER (PARTITION BY source) AS p FROM c) SELECT source, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY source")
def type_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    mass = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum(F.length("text")).alias("m"))
    p = mass.withColumn("p", F.col("m") / F.sum("m").over(Window.partitionBy("source")))
    return p.groupBy("source").agg(F.round(-F.sum(F.col("p") * F.log("p")), 6).alias("entropy"))


_COLS = {"l_quantity": True, "l_discount": True, "l_linenumber": True, "l_returnflag": False, "l_linestatus": False}


@query("column_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS rows, count(DISTINCT {c}) AS \"distinct\", " + ("'numeric' AS kind, min(" + c + ")::DOUBLE AS low, max(" + c + ")::DOUBLE AS high, NULL::VARCHAR AS sample" if numeric else f"CASE WHEN count(DISTINCT {c}) <= 6 THEN 'enum' ELSE 'text' END AS kind, NULL::DOUBLE AS low, NULL::DOUBLE AS high, min({c}) AS sample") + " FROM lineitem" for c, numeric in _COLS.items()))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(table(spark, sf_dir, "lineitem"), list(_COLS))


JSON = [(1, '{"id": 1, "name": "a", "tags": ["x"]}'), (2, '{"id": 2, "ratio": 0.5, "ok": true}'), (3, '{"id": "three", "name": null, "owner": {"k": 1}}')]


@query("json_paths", f"""WITH j AS (SELECT * FROM ({values(JSON)}) t(id, js)), k AS (SELECT js, unnest(json_keys(js)) AS path FROM j), v AS (SELECT path, json_extract_string(js, '$.' || path) AS v FROM k)
SELECT path, string_agg(DISTINCT kind, '|' ORDER BY kind) AS type, count(*) AS present, count(*) < (SELECT count(*) FROM j) AS optional FROM (SELECT path, CASE WHEN v IS NULL THEN 'null' WHEN regexp_matches(v, '^-?[0-9]+$') THEN 'int' WHEN regexp_matches(v, '^-?[0-9]+[.][0-9]+$') THEN 'float' WHEN v IN ('true', 'false') THEN 'bool' WHEN v[1] = '[' THEN 'array' WHEN v[1] = '{{' THEN 'object' ELSE 'str' END AS kind FROM v) GROUP BY path""")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.json_paths(fixture(spark, JSON, "id long, js string"), "js")


@query("json_event_stats", "SELECT event_type, count(*) AS n, CAST(min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS low, CAST(max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS high, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min(k).alias("low"), F.max(k).alias("high"), F.sum(k).alias("total"))


FORMATS = [(1, "3f2504e0-4f89-41d3-9a0c-0305e82c3301"), (2, "2024-01-02T10:11:12"), (3, "2024-01-02"), (4, "a@b.org"), (5, "https://x.org/y"), (6, "PENDING_REVIEW"), (7, "plain words"), (8, "x" * 250)]


@query("string_format", f"SELECT id, CASE WHEN regexp_matches(v, '^[A-Fa-f0-9]{{8}}(-[A-Fa-f0-9]{{4}}){{3}}-[A-Fa-f0-9]{{12}}$') THEN 'str<uuid>' WHEN regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}') THEN 'str<datetime>' WHEN regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'str<date>' WHEN regexp_matches(v, '^[^@ ]+@[^@ ]+[.][A-Za-z]+$') THEN 'str<email>' WHEN regexp_matches(v, '^[a-z]+://') THEN 'str<url>' WHEN regexp_matches(v, '^[A-Z][A-Z_]{{1,24}}$') THEN 'str<enum?>' WHEN length(v) > 200 THEN 'str<long>' ELSE 'str' END AS format FROM ({values(FORMATS)}) t(id, v)")
def string_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, FORMATS, "id long, v string").select("id", profile.string_format(F.col("v")).alias("format"))


_LOG = "(SELECT event_id AS idx, CASE WHEN event_id % 97 = 0 THEN '2024-03-01 10:00:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ' ERROR failed ' || event_type || ' for user ' || user_id ELSE '2024-03-01 10:00:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ' INFO handled ' || event_type || ' in ' || (event_id % 31) || ' ms' END AS line FROM events)"
_BODY = f"regexp_replace(regexp_replace(line, '{lexicon.TIMESTAMP}', ''), '{lexicon.LOG_LEVEL}', '')"
_MASK = _BODY
for _p, _t in profile.MASKS:
    _MASK = f"regexp_replace({_MASK}, '{_p}', '{_t}', 'g')"
_SEV = "CASE level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in profile.SEVERITY.items()) + " ELSE 2 END"


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines made from events."""
    ts = F.concat(F.lit("2024-03-01 10:00:"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"))
    bad = F.concat(ts, F.lit(" ERROR failed "), "event_type", F.lit(" for user "), F.col("user_id").cast("string"))
    good = F.concat(ts, F.lit(" INFO handled "), "event_type", F.lit(" in "), (F.col("event_id") % 31).cast("string"), F.lit(" ms"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.when(F.col("event_id") % 97 == 0, bad).otherwise(good).alias("line"))


@query("log_templates", f"""WITH p AS (SELECT idx, nullif(regexp_extract(line, '{lexicon.TIMESTAMP}', 0), '') AS ts, nullif(regexp_extract(line, '{lexicon.LOG_LEVEL}', 1), '') AS level, trim(regexp_replace(regexp_replace({_MASK}, '^[ \\[\\]|:-]+', ''), '\\s+', ' ', 'g')) AS mask FROM {_LOG}),
g AS (SELECT mask, level, count(*) AS lines, min(idx) AS first_idx, max(idx) AS last_idx, min_by(ts, idx) AS first_ts, max_by(ts, idx) AS last_ts, CAST({_SEV} AS BIGINT) AS severity FROM p GROUP BY mask, level) SELECT *, lines = 1 OR severity >= 4 AS anomalous FROM g""")
def log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.log_templates(event_logs(spark, sf_dir))


TRACE = [(1, "10:00:01 INFO start"), (2, "10:00:02 ERROR boom"), (3, "    at com.example.A.f(A.java:1)"), (4, "    at com.example.B.g(B.java:2)"), (5, "10:00:03 INFO fine"), (6, "    at com.example.C.h(C.java:3)"), (7, "10:00:04 FATAL dead"), (8, "    at com.example.D.i(D.java:4)")]


@query("stack_frames", f"""WITH l AS (SELECT *, regexp_matches(line, '{lexicon.STACK_FRAME}') AS frame, regexp_matches(line, '\\b(ERROR|ERR|FATAL|CRITICAL|SEVERE|PANIC)\\b') AS error FROM ({values(TRACE)}) t(idx, line)),
w AS (SELECT *, last_value(CASE WHEN NOT frame THEN idx END IGNORE NULLS) OVER (ORDER BY idx) AS owner FROM l) SELECT w.idx, w.owner FROM w JOIN l ON l.idx = w.owner WHERE w.frame AND l.error""")
def stack_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.attach_frames(fixture(spark, [(*r, "s") for r in TRACE], "idx long, line string, source string"))


@query("stderr_summary", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount) / sqrt(count(*)), 9) AS stderr FROM lineitem GROUP BY l_returnflag, l_linestatus")
def stderr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(n.alias("n"), F.round(F.avg("l_discount"), 6).alias("mean"), F.round(F.stddev_samp("l_discount") / F.sqrt(n), 9).alias("stderr"))


@query("min_max_scaled", "SELECT o_orderkey, round(CASE WHEN max(o_totalprice) OVER w = min(o_totalprice) OVER w THEN 0 ELSE (o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w) END, 6) AS scaled FROM orders WINDOW w AS (PARTITION BY o_orderpriority)")
def min_max_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two numbers a group, joined back: no group has to pass through one task
    orders = table(spark, sf_dir, "orders")
    ends = orders.groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    scaled = F.when(F.col("hi") == F.col("lo"), 0.0).otherwise((F.col("o_totalprice") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return orders.join(ends, "o_orderpriority").select("o_orderkey", F.round(scaled, 6).alias("scaled"))


@query("group_value", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS value FROM lineitem GROUP BY l_returnflag")
def group_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("value"))


@query("fractional_fill", """WITH o AS (SELECT *, l_extendedprice AS value, l_quantity AS cost FROM lineitem), r AS (SELECT *, sum(cost) OVER (PARTITION BY l_orderkey ORDER BY value / cost DESC, l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM o)
SELECT l_orderkey, round(sum(value * greatest(0, least(1, (60 - (used - cost)) / cost))), 6) AS bound FROM r GROUP BY l_orderkey""")
def fractional_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper bound of a budgeted selection: items by value per cost, the last one in part."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("cost"))
    order = Window.partitionBy("l_orderkey").orderBy(F.desc(F.col("value") / F.col("cost")), "l_linenumber", "l_partkey", "l_suppkey", "cost").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = items.withColumn("used", F.sum("cost").over(order))
    share = F.greatest(F.lit(0), F.least(F.lit(1), (60 - (F.col("used") - F.col("cost"))) / F.col("cost")))
    return used.groupBy("l_orderkey").agg(F.round(F.sum(F.col("value") * share), 6).alias("bound"))
