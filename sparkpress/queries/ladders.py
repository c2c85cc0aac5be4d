"""Ladders, protection, rendering, verification: on the shared tables where they have what it takes, else on literal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text as T
from ..operators import ladders, lines, render, terms
from .registry import fixture, query, table, values
from .text import _COST, _PIECES, _Q, _TERMS

_TIGHT = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{_Q(lexicon.HEDGE)},? ?', '', 'g'), ' ?[(][A-Za-z ,]{{1,40}}[)]', '', 'g'), '(?i)\\b({'|'.join(lexicon.FILLERS)})\\b,? ?', '', 'g'), '\\s+', ' ', 'g'))"
_TIGHTEN = f"CASE WHEN regexp_matches(text, '{_Q(lexicon.STRONG)}') OR regexp_matches(text, '{_Q(lexicon.NEGATION)}') OR {_TIGHT} = '' THEN text ELSE upper({_TIGHT}[1]) || substr({_TIGHT}, 2) END"
_EN = "(SELECT doc_id, text FROM documents WHERE lang = 'en')"


def _english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "text")


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> tuple[DataFrame, str]:
    return fixture(spark, rows, schema)


def _sql(rows: list[tuple], schema: str) -> str:
    return f"(SELECT * FROM ({values(rows)}) t({', '.join(c.split()[0] for c in schema.split(', '))}))"


@query("tighten", f"SELECT doc_id, md5({_TIGHTEN}) AS digest FROM {_EN}")
def tighten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _english(spark, sf_dir).select("doc_id", F.md5(ladders.tighten(F.col("text"))).alias("digest"))


_OFFSETS = f"s AS (SELECT doc_id, {T.sentence_sql()} AS a FROM documents), p AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS n, [length(v) FOR v IN a] AS w FROM s), o AS (SELECT doc_id, n, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS sentence, coalesce(list_sum(w[1:n - 1]), 0) + length(x) - length(regexp_replace(x, '^\\s+', '')) AS start FROM p)"


@query("carrier_text", f"WITH {_OFFSETS}, q AS (SELECT * FROM o WHERE sentence <> ''), h AS (SELECT DISTINCT doc_id, n, sentence FROM q, (VALUES (20, 40), (300, 305)) v(a, b) WHERE start < b AND a < start + length(sentence)), k AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY n) AS text FROM h GROUP BY doc_id), z AS (SELECT doc_id, count(*) AS c FROM q GROUP BY doc_id) SELECT k.doc_id, k.text FROM k JOIN z USING (doc_id) JOIN documents d USING (doc_id) WHERE c > 1 AND length(k.text) < 0.8::DOUBLE * length(d.text)")
def carrier_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in ((20, 40), (300, 305))])).alias("x")).select("doc_id", "x.*")
    return ladders.carriers(docs, spans)


_LAD = f"f AS (SELECT doc_id AS uid, text FROM {_EN}), c AS (SELECT uid, 'full' AS name, text FROM f UNION ALL SELECT uid, 'tight', {_TIGHTEN} FROM f), q AS (SELECT uid, name, unnest(regexp_extract_all(text, '{_PIECES}')) AS p FROM c), t AS (SELECT uid, name, CAST(sum({_COST}) AS BIGINT) AS tokens FROM q GROUP BY uid, name), w AS (SELECT a.uid, a.name, a.tokens, b.tokens AS whole FROM t a JOIN t b ON a.uid = b.uid AND b.name = 'full'), r AS (SELECT uid, name, tokens FROM w WHERE name = 'full' OR (whole >= 12 AND tokens < whole - 1) UNION ALL SELECT uid, 'drop', 0 FROM f)"


@query("unit_ladder", f"WITH {_LAD} SELECT uid, CAST(row_number() OVER (PARTITION BY uid ORDER BY tokens, name <> 'drop', name = 'full') - 1 AS BIGINT) AS rung, name, tokens FROM r")
def unit_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders.ladder(_english(spark, sf_dir).withColumnRenamed("doc_id", "uid")).select("uid", "rung", "name", "tokens")


_PROT = [(1, "system", "prose", "Be brief."), (2, "document", "heading", "# Title"), (3, "document", "prose", "You must pay."), (4, "document", "prose", "It is not here."), (5, "document", "prose", "Plain talk."), (6, "example", "prose", "x"), (7, "document", "header", "a | b"), (8, "document", "prose", "total 12 of 30")]
_PROT_SCHEMA = "uid long, role string, kind string, text string"
_LEVEL = f"greatest(CASE WHEN role IN ('system', 'tools', 'instruction', 'query') THEN 3 WHEN role = 'example' THEN 2 ELSE 0 END, CASE WHEN kind IN ('header', 'parameter', 'ddl') THEN 2 WHEN kind IN ('heading', 'definition', 'status') THEN 1 ELSE 0 END, CASE WHEN regexp_matches(text, '{_Q(lexicon.STRONG)}') OR regexp_matches(text, '{_Q(lexicon.SECURITY)}') THEN 2 WHEN regexp_matches(text, '{_Q(lexicon.NEGATION)}') THEN 1 ELSE 0 END)"


@query("protection_seed", f"SELECT doc_id, CAST({_LEVEL} AS BIGINT) AS protection FROM (SELECT doc_id, text, 'document' AS role, 'prose' AS kind FROM {_EN})")
def protection_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _english(spark, sf_dir).select("doc_id", ladders.protection(F.lit("document"), F.lit("prose"), F.col("text")).alias("protection"))


@query("operand_anchors", f"SELECT uid, CAST(CASE WHEN kind = 'prose' AND regexp_matches(text, '[0-9]') THEN greatest(p, 1) ELSE p END AS BIGINT) AS protection FROM (SELECT *, {_LEVEL} AS p FROM {_sql(_PROT, _PROT_SCHEMA)})")
def operand_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = fixture(spark, _PROT, _PROT_SCHEMA)
    return ladders.anchor_operands(units.withColumn("protection", ladders.protection(F.col("role"), F.col("kind"), F.col("text"))), F.lit(True)).select("uid", "protection")


_ORDERS = "SELECT l_orderkey AS request, l_linenumber AS uid, l_linenumber % 4 AS protection, l_quantity AS tokens, CASE WHEN l_returnflag = 'N' THEN 'heading' ELSE 'prose' END AS kind, l_extendedprice AS salience, l_discount * 10 AS rank, CASE WHEN l_linenumber = 1 THEN 'query' ELSE 'document' END AS role, l_tax * 10 AS hit, l_linenumber / 7.0::DOUBLE AS place FROM lineitem"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS request", "l_linenumber AS uid", "l_linenumber % 4 AS protection", "l_quantity AS tokens", "CASE WHEN l_returnflag = 'N' THEN 'heading' ELSE 'prose' END AS kind", "l_extendedprice AS salience", "l_discount * 10 AS rank", "CASE WHEN l_linenumber = 1 THEN 'query' ELSE 'document' END AS role", "l_tax * 10 AS hit", "l_linenumber / 7.0D AS place")


@query("dedup_candidates", f"WITH u AS ({_ORDERS}), s AS (SELECT *, count(*) OVER (PARTITION BY request) AS c FROM u WHERE protection < 3 AND tokens >= 8 AND kind NOT IN ('heading', 'header', 'import', 'schema')) SELECT request, uid, tokens FROM s WHERE c BETWEEN 2 AND 40000")
def dedup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders.dedup_candidates(_orders(spark, sf_dir)).select("request", "uid", "tokens")


@query("personalisation", f"WITH u AS ({_ORDERS}), r AS (SELECT request, uid, 0.05::DOUBLE + CASE WHEN role = 'query' THEN 3.2::DOUBLE ELSE 0 END + CASE WHEN protection >= 2 THEN 0.8::DOUBLE WHEN protection = 1 THEN 0.3::DOUBLE ELSE 0 END + 4.8::DOUBLE * hit + 0.25::DOUBLE * abs(2 * place - 1) + 0.25::DOUBLE * place AS p FROM u) SELECT request, uid, round(p / sum(p) OVER (PARTITION BY request), 6) AS p FROM r")
def personalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rounded as the SQL does, in binary: Spark's own round(p, 6) goes by the shortest decimal, where a half goes the other way
    return ladders.personalisation(_orders(spark, sf_dir)).select("request", "uid", (F.round(F.col("p") * 1e6) / 1e6).alias("p"))


@query("attention", f"WITH u AS (SELECT request, uid, tokens, salience FROM ({_ORDERS})), r AS (SELECT request, uid, salience / max(salience) OVER (PARTITION BY request) / sqrt(greatest(1, tokens / 24::DOUBLE)) AS a FROM u) SELECT request, uid, round(a / max(a) OVER (PARTITION BY request), 6) AS attention FROM r")
def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders.attention(_orders(spark, sf_dir).withColumn("rank", F.col("salience"))).select("request", "uid", F.round("attention", 6).alias("attention"))


@query("drop_notice", f"WITH u AS ({_ORDERS}), r AS (SELECT request, uid, row_number() OVER (PARTITION BY request ORDER BY salience DESC, uid) AS r, count(*) OVER (PARTITION BY request) AS n FROM u) SELECT request, CAST(max(n) AS VARCHAR) || ' dropped: ' || string_agg(CAST(uid AS VARCHAR), ', ' ORDER BY r) AS notice FROM r WHERE r <= 3 GROUP BY request")
def drop_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.drop_notice(_orders(spark, sf_dir), 3)


@query("render_order", "WITH u AS (SELECT l_orderkey AS request, l_suppkey AS doc, l_linenumber AS uid, CAST(l_quantity AS BIGINT) AS rank, l_linenumber AS ord FROM lineitem), b AS (SELECT *, min(rank) OVER (PARTITION BY request, doc) AS best FROM u) SELECT request, doc, uid, CAST(row_number() OVER (PARTITION BY request ORDER BY best, doc, rank, ord) AS BIGINT) AS place FROM b")
def render_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_order(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS request", "l_suppkey AS doc", "l_linenumber AS uid", "CAST(l_quantity AS BIGINT) AS rank", "l_linenumber AS ord"))


_RUNG = [(1, 0, 0, "", ["a"], []), (1, 0, 1, "tight words", ["a"], ["a"]), (1, 0, 2, "full words here", ["a"], ["a"]), (2, 1, 0, "", ["b"], []), (2, 1, 1, "short", ["b"], []), (2, 1, 2, "whole text", ["b"], ["b"]), (3, 2, 0, "", ["c", "d"], []), (3, 2, 1, "some", ["c", "d"], ["c"]), (3, 2, 2, "all of it", ["c", "d"], ["c", "d"]), (4, 3, 0, "", [], []), (4, 3, 1, "verbatim", [], [])]
_RUNG_SCHEMA = "uid long, protection long, rung long, text string, unit_facts array<string>, rung_facts array<string>"
_LISTS = "(SELECT * FROM (VALUES " + ", ".join(f"({u}::BIGINT, {p}::BIGINT, {r}::BIGINT, '{t}', {a or '[]::VARCHAR[]'}, {b or '[]::VARCHAR[]'})" for u, p, r, t, a, b in _RUNG) + ") t(uid, protection, rung, text, unit_facts, rung_facts))"


@query("rung_admissibility", f"SELECT uid, rung, len(list_filter(unit_facts, lambda x: NOT list_contains(rung_facts, x))) = 0 AS admissible FROM {_LISTS}")
def rung_admissibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders.admissible(fixture(spark, _RUNG, _RUNG_SCHEMA)).select("uid", "rung", "admissible")


@query("least_rung", f"WITH a AS (SELECT *, len(list_filter(unit_facts, lambda x: NOT list_contains(rung_facts, x))) = 0 AS ok FROM {_LISTS}), g AS (SELECT uid, protection, min(rung) FILTER (rung > 0) AS s, min(rung) FILTER (ok AND rung > 0) AS w, max(rung) AS l FROM a GROUP BY uid, protection) SELECT uid, CAST(CASE protection WHEN 0 THEN 0 WHEN 1 THEN coalesce(s, l) WHEN 2 THEN coalesce(w, l) ELSE l END AS BIGINT) AS least FROM g")
def least_rung(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders.least_rung(ladders.admissible(fixture(spark, _RUNG, _RUNG_SCHEMA)))


@query("rung_contributions", f"SELECT uid, rung, unnest(list_distinct({_TERMS})) AS concept, 1.0::DOUBLE AS amount FROM {_LISTS} UNION ALL SELECT uid, rung, '@fact:' || unnest(rung_facts), 1.0 FROM {_LISTS}")
def rung_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders.contributions(fixture(spark, _RUNG, _RUNG_SCHEMA))


_CHOSEN = [(1, 0), (2, 2), (3, 1), (4, 0)]


@query("retained_facts", f"SELECT DISTINCT unnest(rung_facts) AS fact FROM {_LISTS} r JOIN {_sql(_CHOSEN, 'uid long, rung long')} c ON r.uid = c.uid AND r.rung = c.rung")
def retained_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders.retained(fixture(spark, _CHOSEN, "uid long, rung long"), fixture(spark, _RUNG, _RUNG_SCHEMA))


_NEEDS = [(2, 1), (3, 4), (1, 4), (3, 2)]


@query("closure_promotion", f"WITH c AS (SELECT * FROM {_sql(_CHOSEN, 'uid long, rung long')}), n AS (SELECT dst AS uid, 1 AS rung FROM {_sql(_NEEDS, 'src long, dst long')} JOIN c ON src = uid WHERE rung > 0) SELECT uid, CAST(max(rung) AS BIGINT) AS rung FROM (SELECT * FROM c UNION ALL SELECT * FROM n) GROUP BY uid")
def closure_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders.promote(fixture(spark, _CHOSEN, "uid long, rung long"), fixture(spark, _NEEDS, "src long, dst long"))


@query("live_canonicals", f"WITH c AS (SELECT * FROM {_sql(_CHOSEN, 'uid long, rung long')}), n AS (SELECT dst AS uid, 1 AS rung FROM {_sql(_NEEDS, 'src long, dst long')} JOIN c ON src = uid WHERE rung > 0) SELECT uid, CAST(max(rung) AS BIGINT) AS rung FROM (SELECT * FROM c UNION ALL SELECT * FROM n) GROUP BY uid")
def live_canonicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders.live_canonicals(fixture(spark, _CHOSEN, "uid long, rung long"), fixture(spark, _NEEDS, "uid long, canonical long"))


@query("fact_tiers", "SELECT l_partkey AS fact, CASE WHEN bool_and(l_linestatus = 'F') THEN 0.01::DOUBLE ELSE max(l_quantity) END AS weight, CAST(CASE WHEN bool_or(l_returnflag = 'R' OR l_returnflag = 'N') THEN 1 ELSE 2 END AS BIGINT) AS tier FROM lineitem GROUP BY l_partkey")
def fact_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders.fact_tiers(table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS fact", "CASE WHEN l_returnflag = 'R' THEN 'security' ELSE 'number' END AS class", "l_quantity AS weight", "l_linestatus = 'F' AS superseded", "l_returnflag = 'N' AS prose"))


_IDENT = dict((c, p) for c, _, _, p in lexicon.LITERALS)["identifier"]


@query("symbol_counts", f"WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_Q(_IDENT)}')) AS name FROM {_EN} WHERE length(text) < 4000) SELECT name, count(*) AS n, list_sort(list_distinct(list(doc_id))) AS units FROM s WHERE length(name) >= 3 GROUP BY name")
def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders.symbols(_english(spark, sf_dir))


_CLAUSES = [(1, 10, "4.1", "See section 4.2 and clause 9."), (1, 11, "4.2", "As in Section 4.1."), (1, 12, "4.2", "later copy, section 4.2"), (2, 13, "9", "section 4.1")]


@query("cross_references", f"WITH c AS (SELECT * FROM {_sql(_CLAUSES, 'doc long, uid long, number string, text string')}), a AS (SELECT DISTINCT doc, uid AS src, split_part(unnest(regexp_extract_all(lower(text), '(section|clause|article) [0-9]+([.][0-9]+)*')), ' ', 2) AS number FROM c), f AS (SELECT doc, number, min(uid) AS dst FROM c GROUP BY doc, number) SELECT src, dst FROM a JOIN f USING (doc, number) WHERE src <> dst")
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders.cross_references(fixture(spark, _CLAUSES, "doc long, uid long, number string, text string"))


@query("row_headers", "SELECT uid AS src, h AS dst FROM (SELECT l_orderkey * 10 + l_linenumber AS uid, first_value(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS h FROM lineitem) WHERE uid <> h")
def row_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders.row_headers(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc", "1 AS block", "l_orderkey * 10 + l_linenumber AS uid", "l_linenumber AS n"))


@query("layout", "WITH p AS (SELECT conv_id AS request, CASE role WHEN 'user' THEN 'query' WHEN 'assistant' THEN 'document' ELSE 'system' END AS section, turn AS ord, text FROM conversations), i AS (SELECT request, list_position(['system', 'tools', 'instruction', 'query', 'document', 'facts', 'notice'], section) AS r, string_agg(text, chr(10) ORDER BY ord, text) AS t FROM p GROUP BY 1, 2) SELECT request, md5(string_agg(t, chr(10) || chr(10) ORDER BY r)) AS digest FROM i GROUP BY request")
def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "conversations").selectExpr("conv_id AS request", "CASE role WHEN 'user' THEN 'query' WHEN 'assistant' THEN 'document' ELSE 'system' END AS section", "turn AS ord", "text")
    return render.layout(parts).select("request", F.md5("text").alias("digest"))


@query("alias_table", "WITH f AS (SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+( [A-Z][a-z]+)+')) AS name FROM documents) GROUP BY doc_id, name), w AS (SELECT * FROM f WHERE n >= 2 AND n * (length(name) - 2) > length(name) + 4) SELECT doc_id, name, '~' || row_number() OVER (PARTITION BY doc_id ORDER BY n * length(name) DESC, name) AS alias, n FROM w")
def alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.aliases(table(spark, sf_dir, "documents"), 2)


_SRC = [(1, "Pay 250 euros, 3 times. Keys: {\"a\": 1, \"b\": 2}"), (2, "No number"), (3, "12.5 and 7")]
_OUT = [(1, "Pay 950 euros x3, n=17 {\"a\": 1}"), (2, "now 4"), (3, "12.5")]
_SS, _SO = _sql(_SRC, "doc_id long, text string"), _sql(_OUT, "doc_id long, text string")


@query("foreign_numbers", f"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^0-9]{{0,8}}[0-9]+([.][0-9]+)?')) AS m FROM {_SO}), n AS (SELECT DISTINCT doc_id, regexp_extract(m, '([0-9]+([.][0-9]+)?)$', 1) AS number FROM m WHERE NOT regexp_matches(regexp_replace(m, '[0-9]+([.][0-9]+)?$', ''), '(?i)(x|[a-z]+=) ?$')), h AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+([.][0-9]+)?')) AS number FROM {_SS}) SELECT n.* FROM n ANTI JOIN h USING (doc_id, number)")
def foreign_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.foreign_numbers(fixture(spark, _SRC, "doc_id long, text string"), fixture(spark, _OUT, "doc_id long, text string"))


@query("json_key_recall", f"WITH k AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\"[A-Za-z_][A-Za-z0-9_]*\" *:')) AS k FROM {_SS}), o AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\"[A-Za-z_][A-Za-z0-9_]*\" *:')) AS k FROM {_SO}) SELECT k.doc_id, count(o.k) / count(*) AS recall FROM k LEFT JOIN o ON k.doc_id = o.doc_id AND k.k = o.k GROUP BY k.doc_id")
def json_key_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.json_key_recall(fixture(spark, _SRC, "doc_id long, text string"), fixture(spark, _OUT, "doc_id long, text string"))


@query("frozen_kept", "SELECT a.doc_id, contains(a.text, substr(a.text, 1, 20)) AND contains(a.text, 'the') AS kept FROM documents a")
def frozen_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return render.frozen_kept(docs.select("doc_id", F.substring("text", 1, 20).alias("text")).unionByName(docs.select("doc_id", F.lit("the").alias("text"))), docs)


@query("distractor_rate", "SELECT doc_id, avg(CASE WHEN contains(text, 'the') AND NOT contains(text, 'and') THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM documents GROUP BY doc_id")
def distractor_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.distractor_rate(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("out"), F.lit("and").alias("gold"), F.lit("the").alias("distractor")))


@query("token_dropping", "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9_]+'), 1) - 1 AS pos FROM documents), f AS (SELECT word, -ln(count(*) / sum(count(*)) OVER ()) AS information FROM w GROUP BY word), r AS (SELECT doc_id, pos, word, row_number() OVER (PARTITION BY doc_id ORDER BY round(information, 9) DESC, pos) AS r, count(*) OVER (PARTITION BY doc_id) AS total FROM w JOIN f USING (word)) SELECT doc_id, CAST(pos AS BIGINT) AS pos, word FROM r WHERE r <= total * 0.25::DOUBLE")
def token_dropping(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    if (kept := terms.dropped_tokens(docs, 0.25)) is not None:
        return kept
    words = docs.select("doc_id", F.posexplode(T.words(F.col("text"))).alias("pos", "word")).join(terms.self_information(docs).select("word", "information"), "word")
    return render.drop_tokens(words, 0.25).withColumn("pos", F.col("pos").cast("long"))


@query("repair_sentences")
def repair_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans import engine

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return render.repair(lines.simple_sentences(docs), engine.compress(docs))


@query("python_parses")
def python_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.python_parses(fixture(spark, [(1, "x = 1"), (2, "def f(:"), (3, ""), (4, None)], "id long, text string"))
