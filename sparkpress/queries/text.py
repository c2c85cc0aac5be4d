"""Scans, scalar text functions, predicates and segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon, shared
from ..functions import text as T
from ..operators import lines, terms
from .registry import fixture, query, table, values

LINES = [
    (1, "# Service guide"), (2, "2.1 Rate limits"), (3, "OVERVIEW OF LIMITS"), (4, "Known issues:"), (5, "plain text, nothing more."),
    (6, "- first point"), (7, "12) twelfth point"), (8, "a. lettered point"), (9, ""), (10, "### Deep heading here"), (11, "STOP!"),
    (12, "You must not log the api key, it is confidential."), (13, "Retry at most 5 times per minute"), (14, "Hi there, how are you?"), (15, "ok!"),
    (16, "Licensed under the MIT licence"), (17, "Certainly! Here is what I found."), (18, "For example, a cache."), (19, "It is important to note that basically this just works, as mentioned."),
    (20, "2024-05-01 12:00:01 ERROR disk full on node 7"), (21, "user: what is the total cost?"), (22, "    at com.example.Main.run(Main.java:10)"), (23, "pursuant to section 4.2 the parties agree"),
    (24, "GET /v1/items returns 404 - endpoint missing"), (25, "Unless stated otherwise, avoid retries before noon"), (26, "let x = compute(1); and so on then and"), (27, "This is a clean sentence with enough words (really)."),
    (28, "We cannot ship without tests because"), (29, "parseHttpHeader MAX_SIZE user_name NASA and EU-27 rules"), (30, "  trailing, dots ...  "),
]
_L = f"(SELECT * FROM ({values(LINES)}) t(id, line))"
_WORDS = "regexp_extract_all(lower({}), '[a-z0-9_]+')"
_STOP = "[" + ", ".join(f"'{w}'" for w in lexicon.STOPWORDS) + "]"
_TERMS = f"[w FOR w IN {_WORDS.format('text')} IF length(w) >= 2 AND NOT list_contains({_STOP}, w) AND NOT regexp_matches(w, '^[0-9]')]"
_Q = lambda p: p.replace("'", "''")


def _lines(spark: SparkSession) -> DataFrame:
    return fixture(spark, LINES, "id long, line string")


@query("line_offsets", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS BIGINT) AS start, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS BIGINT) AS stop, line FROM l""")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_offsets(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("text_blocks", """WITH d AS (SELECT doc_id, regexp_replace(text, '[.] ', '.' || chr(10) || chr(10), 'g') AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d),
f AS (SELECT *, trim(line) = '' AS blank, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM l)
SELECT doc_id, CAST(island AS BIGINT) AS block, CAST(min(n) AS BIGINT) AS first_line, CAST(max(n) AS BIGINT) AS last_line, CAST(sum(length(line)) AS BIGINT) AS chars FROM f WHERE NOT blank GROUP BY doc_id, island""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[.] ", ".\n\n").alias("text"))
    return lines.blocks(docs)


_PIECES = T.PIECES.replace("'", "''")
_CORE = "trim(regexp_replace(p, '[\\n\\t\\r]', ' ', 'g'))"
_NL = "(length(p) - length(replace(p, chr(10), '')))"
_COST = f"""CASE WHEN length({_CORE}) = 0 THEN {_NL} + CASE WHEN length(p) - {_NL} > 1 THEN 1 ELSE 0 END
 WHEN regexp_matches({_CORE}, '^[0-9]+$') THEN floor((length({_CORE}) + 2) / 3)
 WHEN regexp_matches({_CORE}, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]') THEN CASE WHEN length({_CORE}) <= 4 THEN 1 ELSE greatest(1, floor(length({_CORE}) / 7.8::DOUBLE + 0.95::DOUBLE)) + CASE WHEN lower({_CORE}) <> {_CORE} AND length({_CORE}) > 12 THEN 1 ELSE 0 END END
 ELSE ceil(length({_CORE}) / 3.2::DOUBLE) END"""


@query("token_count", f"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_PIECES}')) AS p FROM documents)
SELECT d.doc_id, CAST(coalesce(c, 0) AS BIGINT) AS tokens FROM documents d LEFT JOIN (SELECT doc_id, sum({_COST}) AS c FROM p GROUP BY doc_id) USING (doc_id)""")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("truncate_to_budget", f"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_PIECES}')) AS p, generate_subscripts(regexp_extract_all(text, '{_PIECES}'), 1) AS n FROM documents), c AS (SELECT *, sum({_COST}) OVER (PARTITION BY doc_id ORDER BY n) AS used FROM p)
SELECT doc_id, string_agg(p, '' ORDER BY n) AS head, CAST(max(used) AS BIGINT) AS tokens FROM c WHERE used <= 64 GROUP BY doc_id""")
def truncate_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.truncate(table(spark, sf_dir, "documents").select("doc_id", "text"), 64)


@query("heading_level", f"""SELECT id, CAST(CASE WHEN length(s) = 0 THEN 0 WHEN marks > 0 THEN marks WHEN dots <> '' AND length(s) < 120 THEN least(6, length(dots) - length(replace(dots, '.', '')) + 1)
 WHEN length(s) < 90 AND upper(s) = s AND lower(s) <> s AND NOT regexp_matches(s, '[.!?]$') THEN 2 WHEN length(s) < 90 AND regexp_matches(s, '^[A-Z][A-Za-z0-9_ /&,''-]+:$') THEN 3 ELSE 0 END AS BIGINT) AS level
FROM (SELECT id, trim(line) AS s, length(regexp_extract(trim(line), '^(#{{1,6}})[ \\t]+[^ \\t]', 1)) AS marks, regexp_extract(trim(line), '^([0-9]+([.][0-9]+)*)[).]?[ \\t]+[A-Z]', 1) AS dots FROM {_L})""")
def heading_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark).select("id", T.heading_level(F.col("line")).alias("level"))


@query("list_item", f"SELECT id, regexp_matches(line, '^\\s*([-*+•]|[0-9]{{1,3}}[.)]|[a-z][.)])\\s+\\S') AS is_item FROM {_L}")
def list_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark).select("id", T.list_item(F.col("line")).alias("is_item"))


@query("content_terms", f"SELECT doc_id, {_TERMS} AS terms FROM documents")
def content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.content_terms(F.col("text")).alias("terms"))


@query("term_bigrams", f"SELECT doc_id, CAST(len(b) AS BIGINT) AS n, md5(array_to_string(b, '|')) AS digest FROM (SELECT doc_id, [t[i] || '_' || t[i + 1] FOR i IN range(1, len(t))] AS b FROM (SELECT doc_id, {_TERMS} AS t FROM documents))")
def term_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.bigram_digests(table(spark, sf_dir, "documents"))


@query("entities", f"SELECT id, list_distinct(regexp_extract_all(line, '\\b[A-Z][A-Z]{{1,7}}(-[0-9]+)?\\b')) AS acronyms, list_distinct(regexp_extract_all(line, '\\b([a-z]+[0-9]*(_[0-9a-z]+)+|[a-z]+([A-Z][0-9a-z]+)+|[A-Z]+[0-9]*(_[0-9A-Z]+)+)\\b')) AS identifiers FROM {_L}".replace("list_distinct(", "list_sort(list_distinct(").replace("\\b'))", "\\b')))"))
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = dict((c, p) for c, _, _, p in lexicon.LITERALS)["identifier"]
    sets = lambda p: F.array_sort(F.array_distinct(T.matches(F.col("line"), p)))
    return _lines(spark).select("id", sets(r"\b[A-Z][A-Z]{1,7}(-[0-9]+)?\b").alias("acronyms"), sets(pattern).alias("identifiers"))


_HASH = "trim(regexp_replace(regexp_replace(lower(text), '[0-9]+([.][0-9]+)?', '#', 'g'), '\\s+', ' ', 'g'))"


@query("hash_form", f"SELECT doc_id, md5({_HASH}) AS digest FROM documents")
def hash_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.hash_form(F.col("text"))).alias("digest"))


@query("shingles", f"""WITH w AS (SELECT doc_id, regexp_extract_all({_HASH}, '[a-z0-9_]+') AS w FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END AS s FROM w)""")
def shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", T.shingles(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("canonical", f"SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(line), ',', '', 'g'), '\\s+', ' ', 'g'), '^[ .,;:]+|[ .,;:]+$', '', 'g') AS canon FROM {_L}")
def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark).select("id", T.canonical(F.col("line")).alias("canon"))


_FILL = "[" + ", ".join(f"'{w}'" for w in lexicon.FILLERS) + "]"


@query("filler_and_hedge", f"""SELECT id, round(CASE WHEN length(line) = 0 THEN 0.0 ELSE least(1.0, coalesce(list_sum([length(m) FOR m IN regexp_extract_all(line, '{_Q(lexicon.HEDGE)}')]), 0) * 3.0::DOUBLE / length(line)) END, 6)::DOUBLE AS hedge,
round(least(1.0, (len([w FOR w IN {_WORDS.format('line')} IF list_contains({_FILL}, w)]) + 3 * len(regexp_extract_all(line, '{_Q(lexicon.HEDGE)}'))) / greatest(6, len({_WORDS.format('line')}))::DOUBLE), 6)::DOUBLE AS filler FROM {_L}""")
def filler_and_hedge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark).select("id", F.round(T.hedge_ratio(F.col("line")), 6).alias("hedge"), F.round(T.filler_ratio(F.col("line")), 6).alias("filler"))


@query("budget_class", "SELECT CAST(b AS BIGINT) AS budget, CAST(CASE WHEN b <= 0 THEN 0 ELSE least(8, floor(log2(b) * 8 / 20)) END AS BIGINT) AS class FROM (SELECT unnest([0, 1, 3, 10, 100, 1000, 5000, 30000, 200000, 1100000]) AS b)")
def budget_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, [(b,) for b in (0, 1, 3, 10, 100, 1000, 5000, 30000, 200000, 1100000)], "budget long").select("budget", T.budget_class(F.col("budget")).alias("class"))


@query("query_class", f"SELECT item_id, md5(array_to_string(list_sort(list_distinct({_TERMS}))[1:8], '|')) AS class FROM benchmark")
def query_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.query_class(F.col("text")).alias("class"))


PREDICATES = {"strong": lexicon.STRONG, "quantity": lexicon.QUANTITY, "soft": lexicon.SOFT, "negation": lexicon.NEGATION, "security": lexicon.SECURITY, "small_talk": lexicon.SMALL_TALK, "opener": lexicon.ASSISTANT_OPENER, "boilerplate": lexicon.BOILERPLATE_LINE, "hedge": lexicon.HEDGE, "example": lexicon.EXAMPLE_LEAD, "legal": lexicon.LEGAL, "api_doc": lexicon.API_DOC, "log_level": lexicon.LOG_LEVEL, "timestamp": lexicon.TIMESTAMP, "role": lexicon.ROLE_MARKER, "frame": lexicon.STACK_FRAME, "compute": lexicon.COMPUTE, "licence": lexicon.LICENCE}


@query("line_predicates", "SELECT id, " + ", ".join(f"regexp_matches(line, '{_Q(p)}') AS {name}" for name, p in PREDICATES.items()) + f", regexp_matches(line, '{_Q(lexicon.QUANTITY)}') AND regexp_matches(line, '[0-9]') AS bound FROM {_L}")
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.flags(_lines(spark), PREDICATES).withColumn("bound", F.col("quantity") & F.col("line").rlike("[0-9]")).drop("line")


@query("document_predicates", "SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{_Q(PREDICATES[n])}')) AS BIGINT) AS {n}" for n in ("strong", "negation", "security", "legal", "licence")) + " FROM documents WHERE lang = 'en'")
def document_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", *[T.count_matches(F.col("text"), PREDICATES[n]).alias(n) for n in ("strong", "negation", "security", "legal", "licence")])


@query("prose_fragment", f"""SELECT id, len({_WORDS.format('line')}) >= 5 AND length(regexp_replace(line, '[^A-Za-z\\s]', '', 'g')) >= 0.72::DOUBLE * length(line) AND length(line) - length(replace(line, '(', '')) = length(line) - length(replace(line, ')', '')) AND NOT regexp_matches(line, '[=;]') AS fragment,
regexp_replace(line, '(?i)[\\s,;:]+(and|or|but|because|which|that|with|for|to|of)?[\\s,;:]*$', '') AS trimmed, regexp_replace(line, '{_Q(lexicon.ASSISTANT_OPENER)}', '') AS body FROM {_L}""")
def prose_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    return _lines(spark).select("id", T.prose_fragment(line).alias("fragment"), T.trim_dangling(line).alias("trimmed"), T.without_opener(line).alias("body"))


@query("sentences", f"""WITH s AS (SELECT doc_id, unnest({T.sentence_sql()}) AS sentence, generate_subscripts({T.sentence_sql()}, 1) AS n FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS n, trim(sentence) AS sentence FROM s WHERE trim(sentence) <> ''""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.simple_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("sentence_offsets", f"""WITH s AS (SELECT doc_id, {T.sentence_sql()} AS a FROM documents), p AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS n, [length(v) FOR v IN a] AS w FROM s), o AS (SELECT doc_id, n, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS sentence, coalesce(list_sum(w[1:n - 1]), 0) + length(x) - length(regexp_replace(x, '^\\s+', '')) AS start FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(start AS BIGINT) AS start, CAST(start + length(sentence) AS BIGINT) AS stop, sentence FROM o WHERE sentence <> ''""")
def sentence_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.sentence_offsets(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("fences", """WITH l AS (SELECT * FROM (VALUES (1, 'intro'), (2, '```python'), (3, 'x = 1'), (4, '```'), (5, 'middle'), (6, '~~~'), (7, 'raw'), (8, '~~~'), (9, 'end')) t(n, line)), f AS (SELECT *, regexp_matches(line, '^[ \\t]*(~~~|```)') AS mark FROM l),
g AS (SELECT *, sum(CASE WHEN mark THEN 1 ELSE 0 END) OVER (ORDER BY n) AS opened FROM f)
SELECT CAST(n AS BIGINT) AS n, CASE WHEN mark THEN 'markdown' WHEN opened % 2 = 1 THEN coalesce(nullif(last_value(CASE WHEN mark THEN regexp_extract(line, '^[ ]*(~~~|```)([a-z]*)', 2) END IGNORE NULLS) OVER (ORDER BY n), ''), 'code') ELSE 'open' END AS label FROM g""")
def fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = list(enumerate(["intro", "```python", "x = 1", "```", "middle", "~~~", "raw", "~~~", "end"], 1))
    return lines.fences(fixture(spark, [(1, *r) for r in rows], "doc_id long, n long, line string")).select("n", "label")


@query("estimate", f"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_PIECES}')) AS p FROM documents), c AS (SELECT doc_id, CAST(sum({_COST}) AS BIGINT) AS tokens FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(length(text) AS BIGINT) AS chars, coalesce(tokens, 0) AS tokens, CAST(floor(coalesce(tokens, 0) * 0.5::DOUBLE) AS BIGINT) AS conservative, CAST(floor(coalesce(tokens, 0) * 0.25::DOUBLE) AS BIGINT) AS balanced, CAST(floor(coalesce(tokens, 0) * 0.12::DOUBLE) AS BIGINT) AS aggressive FROM documents d LEFT JOIN c USING (doc_id)""")
def estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), T.token_count(F.col("text")).alias("tokens"))
    size = lambda share: F.floor(F.col("tokens") * F.lit(share)).cast("long")
    return base.select("*", size(0.5).alias("conservative"), size(0.25).alias("balanced"), size(0.12).alias("aggressive"))
