"""Atomic facts, audits and metrics. Literal fixtures stand in for features that the shared documents lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text as T
from ..operators import facts
from .registry import fixture, query, table, values

UNITS = [
    (1, "See https://example.org/a/b?x=1 or mail ops@example.org by 2024-05-01."),
    (2, "Payments above $1,200.50 need 2.5% fee; you must not retry more than 3 times."),
    (3, "Build v1.20.3 lives in /srv/app/releases/current and uses MAX_SIZE and user_name."),
    (4, "Timeout is 30 seconds, at most 5 retries per minute; never log the api key."),
    (5, '{"limit": 10, "owner_name": "x"} id 3f2504e0-4f89-41d3-9a0c-0305e82c3301'),
    (6, "No numbers here. Nothing is required, but parseHttpHeader is called."),
    (7, "The rate was 12 in 2023 and 15 in 2024, up 25 %."), (8, "Zero 0 one 1 two 2 and a_b."),
]
#: A lossy output of the same units.
KEPT = [(1, "See https://example.org/a/b?x=1 by 2024-05-01."), (2, "you must not retry more than 3 times"), (3, "v1.20.3 uses MAX_SIZE and the cache."), (4, "Timeout is 30 seconds; never log the api key."), (5, '"limit": 10'), (7, "The rate was 12 in 2023")]
_U, _K = (f"(SELECT * FROM ({values(r)}) t(doc_id, text))" for r in (UNITS, KEPT))
_Q = lambda p: p.replace("'", "''")
_CANON = "regexp_replace(regexp_replace(regexp_replace(lower({0}), ',', '', 'g'), '\\s+', ' ', 'g'), '^[ .,;:]+|[ .,;:]+$', '', 'g')"


def _lit(source: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{c}' AS class, '{p}' AS prefix, unnest(regexp_extract_all(text, '{_Q(r)}')) AS literal FROM {source}" for c, p, _, r in lexicon.LITERALS)


def _facts(name: str, source: str) -> str:
    canon = f"regexp_replace({_CANON.format('literal')}, '[/]+$', '')"
    weight = "CASE class " + " ".join(f"WHEN '{c}' THEN {w}::DOUBLE" for c, w in facts.WEIGHTS.items()) + " END"
    return f"""{name}_l AS ({_lit(source)}), {name}_k AS (SELECT doc_id, class, literal, prefix || ':' || {canon} AS fact FROM {name}_l WHERE NOT (class = 'number' AND {canon} IN ('0', '1', '2')) AND NOT (class = 'identifier' AND length({canon}) < 3)),
{name}_c AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.;!?\\n]+'))) AS clause FROM {source}), {name}_p AS (SELECT doc_id, clause, unnest(list_filter([CASE WHEN regexp_matches(clause, '{_Q(lexicon.STRONG)}') OR regexp_matches(clause, '{_Q(lexicon.QUANTITY)}') AND regexp_matches(clause, '[0-9]') AND len(regexp_extract_all(lower(clause), '[a-z0-9_]+')) >= 4 THEN 'constraint' END, CASE WHEN regexp_matches(clause, '{_Q(lexicon.NEGATION)}') THEN 'negation' END, CASE WHEN regexp_matches(clause, '{_Q(lexicon.SECURITY)}') THEN 'security' END], lambda x: x IS NOT NULL)) AS class FROM {name}_c WHERE clause <> ''),
{name} AS (SELECT *, {weight} AS weight FROM (SELECT * FROM {name}_k UNION ALL SELECT doc_id, class, clause, class[1] || 'c:' || md5({_CANON.format('clause')})[1:16] FROM {name}_p))"""


def _units(spark: SparkSession, rows: list[tuple] = UNITS) -> DataFrame:
    return fixture(spark, rows, "doc_id long, text string")


def _literal_query(name: str, pattern: str) -> None:
    @query(f"literal_{name}", f"SELECT doc_id, '{name}' AS class, unnest(regexp_extract_all(text, '{_Q(pattern)}')) AS literal FROM {_U} UNION ALL SELECT doc_id, '{name}', unnest(regexp_extract_all(text, '{_Q(pattern)}')) FROM documents")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return facts.literals(_units(spark).unionByName(table(spark, sf_dir, "documents").select("doc_id", "text")), name)


for _name, _, _, _pattern in lexicon.LITERALS:
    _literal_query(_name, _pattern)


@query("facts", f"WITH {_facts('f', _U)} SELECT doc_id, class, literal, fact, weight FROM f")
def all_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.facts(_units(spark)).select("doc_id", "class", "literal", "fact", "weight")


@query("fact_merge", f"""WITH {_facts('f', "(SELECT doc_id, text FROM documents WHERE lang = 'en')")} SELECT fact, min(class) AS class, min_by(literal, struct_pack(doc_id, literal)) AS literal, max(weight) AS weight, count(DISTINCT doc_id) AS n_owners FROM f GROUP BY fact""")
def fact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.merge(facts.facts(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "text")))


@query("fact_policy", f"WITH {_facts('f', _U)} SELECT class, count(DISTINCT fact) AS n, class IN ({', '.join(repr(c) for c in facts.CRITICAL)}) AS critical FROM f GROUP BY class")
def fact_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.facts(_units(spark)).groupBy("class").agg(F.count_distinct("fact").alias("n")).withColumn("critical", F.col("class").isin(facts.CRITICAL))


_BOTH = f"WITH {_facts('s', _U)}, {_facts('o', _K)}, sd AS (SELECT DISTINCT doc_id, fact, class, weight FROM s), od AS (SELECT DISTINCT doc_id, fact FROM o)"


@query("audit_missing", f"{_BOTH} SELECT sd.* FROM sd ANTI JOIN od USING (doc_id, fact)")
def audit_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.missing(facts.facts(_units(spark)), facts.facts(_units(spark, KEPT)))


@query("audit", f"""{_BOTH}, d AS (SELECT DISTINCT doc_id, fact, class FROM s), j AS (SELECT d.*, od.fact IS NOT NULL AS held, class IN ({', '.join(repr(c) for c in facts.CRITICAL)}) AS crit FROM d LEFT JOIN od ON d.doc_id = od.doc_id AND d.fact = od.fact)
SELECT doc_id, count(*) AS total, count(*) FILTER (held) AS kept, count(*) FILTER (crit) AS critical_total, count(*) FILTER (crit AND held) AS critical_kept, round(count(*) FILTER (held) / count(*), 6) AS retention FROM j GROUP BY doc_id""")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.audit(facts.facts(_units(spark)), facts.facts(_units(spark, KEPT))).withColumn("retention", F.round("retention", 6))


@query("repair_queue", f"{_BOTH} SELECT sd.* FROM sd ANTI JOIN od USING (doc_id, fact) ORDER BY CASE WHEN class IN ({', '.join(repr(c) for c in facts.CRITICAL)}) THEN 0 ELSE 1 END, weight DESC, doc_id, fact, class LIMIT 8")
def repair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = facts.missing(facts.facts(_units(spark)), facts.facts(_units(spark, KEPT)))
    return gone.orderBy(F.when(F.col("class").isin(facts.CRITICAL), 0).otherwise(1), F.desc("weight"), "doc_id", "fact", "class").limit(8)


_W = "regexp_extract_all(lower(text), '[a-z0-9_]+')"


@query("provenance", f"WITH o AS (SELECT doc_id, unnest(list_distinct({_W})) AS word FROM {_K}), s AS (SELECT doc_id, unnest(list_distinct({_W})) AS word FROM {_U}) SELECT o.* FROM o ANTI JOIN s USING (doc_id, word)")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.provenance(_units(spark), _units(spark, KEPT))


@query("query_coverage", f"WITH q AS (SELECT item_id, list_distinct({_W}) AS q FROM benchmark), d AS (SELECT doc_id, list_distinct({_W}) AS w FROM documents) SELECT item_id, doc_id, coverage FROM (SELECT item_id, doc_id, round(len(list_intersect(q, w)) / len(q), 6) AS coverage, len(list_intersect(q, w)) AS n FROM q, d) WHERE n > 0")
def query_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.coverage(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")).withColumn("coverage", F.round("coverage", 6))


@query("answerability", f"WITH g AS (SELECT item_id, {_CANON.format('text')} AS gold FROM benchmark), d AS (SELECT doc_id, {_CANON.format('text')} AS body FROM documents) SELECT doc_id, item_id FROM d JOIN g ON contains(body, gold)")
def answerability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.answerable(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query("number_recall", f"WITH s AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9]+([.][0-9]+)?')) AS n FROM {_U}), o AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9]+([.][0-9]+)?')) AS n FROM {_K}) SELECT s.doc_id, round(count(o.n) / count(*), 6) AS recall FROM s LEFT JOIN o ON s.doc_id = o.doc_id AND s.n = o.n GROUP BY s.doc_id")
def number_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = lambda df: df.select("doc_id", F.explode(F.array_distinct(T.matches(F.col("text"), "[0-9]+([.][0-9]+)?"))).alias("n"))
    out = numbers(_units(spark, KEPT)).withColumn("held", F.lit(1))
    return numbers(_units(spark)).join(out, ["doc_id", "n"], "left").groupBy("doc_id").agg(F.round(F.count("held") / F.count(F.lit(1)), 6).alias("recall"))


@query("spans")
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.spans(_units(spark).unionByName(table(spark, sf_dir, "documents").select("doc_id", "text")))


SPANS = [(1, 0, 5), (1, 3, 9), (1, 9, 12), (1, 20, 25), (2, 4, 6), (2, 1, 10), (2, 12, 13)]


@query("merged_spans", f"""WITH o AS (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({values(SPANS)}) t(doc_id, start, stop)), i AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, stop) AS island FROM o) SELECT doc_id, min(start) AS start, max(stop) AS stop FROM i GROUP BY doc_id, island""")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.merge_spans(fixture(spark, SPANS, "doc_id long, start long, stop long"))
