"""Near duplicates, similarity, lexical edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import similarity, terms
from .aggregates import _VEC
from .registry import fixture, query, table, values
from .text import _HASH


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _shingles(k: int, source: str = "documents") -> str:
    return f"w{k} AS (SELECT doc_id, regexp_extract_all({_HASH}, '[a-z0-9_]+') AS w FROM {source}), s{k} AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k - 2})] END) AS shingle FROM w{k})"


_H = "CAST(('0x' || substr(md5(shingle), 1, 15)) AS BIGINT)"
_SIM = f"{_shingles(4, 'documents')}, h AS (SELECT doc_id, {_H} AS h FROM s4), f AS (SELECT doc_id, " + " + ".join(f"CASE WHEN sum(CASE WHEN (h >> {b}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN {1 << b}::BIGINT ELSE 0 END" for b in range(60)) + " AS fingerprint FROM h GROUP BY doc_id)"


@query("dup_exact", "SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def dup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _docs(spark, sf_dir).select("doc_id", F.md5("text").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))
    return groups.where("copies > 1")


@query("dup_normal_form", f"SELECT md5({_HASH}) AS digest, count(*) AS copies FROM documents GROUP BY 1")
def dup_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import text as T

    return _docs(spark, sf_dir).groupBy(F.md5(T.hash_form(F.col("text"))).alias("digest")).agg(F.count(F.lit(1)).alias("copies"))


@query("simhash", f"WITH {_SIM} SELECT doc_id, fingerprint FROM f")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.simhash(_docs(spark, sf_dir))


@query("simhash_pairs", f"WITH {_SIM}, b AS (SELECT doc_id, fingerprint, band, (fingerprint >> (band * 10)) & 1023 AS value FROM f, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS band)) SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, CAST(bit_count(xor(x.fingerprint, y.fingerprint)) AS BIGINT) AS distance FROM b x JOIN b y ON x.band = y.band AND x.value = y.value AND x.doc_id < y.doc_id WHERE bit_count(xor(x.fingerprint, y.fingerprint)) <= 12")
def simhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = similarity.simhash(_docs(spark, sf_dir))
    b = similarity.bands(f).join(f, "doc_id")
    x, y = (b.select("band", "value", F.col("doc_id").alias(n), F.col("fingerprint").alias(f"f{n}")) for n in ("a", "b"))
    pairs = x.join(y, ["band", "value"]).where("a < b").select("a", "b", F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))).cast("long").alias("distance"))
    return pairs.where("distance <= 12").distinct()


@query("minhash", f"WITH {_shingles(3, 'documents')}, h AS (SELECT doc_id, {_H} % 2147483647 AS h FROM s3) SELECT doc_id, [" + ", ".join(f"min(({2 * i + 1} * h + {7919 * (i + 1)}) % 2147483647)" for i in range(16)) + "] AS signature FROM h GROUP BY doc_id")
def minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.minhash(_docs(spark, sf_dir))


_JACCARD = f"{_shingles(3)}, h AS (SELECT doc_id, list_sort(list(shingle)) AS g FROM s3 GROUP BY doc_id), p AS (SELECT min(doc_id) AS id, g, len(g) AS size FROM h GROUP BY g), x AS (SELECT id, size, unnest(g) AS shingle FROM p), n AS (SELECT a.id AS a, b.id AS b, count(*) AS common, count(*) / (a.size + b.size - count(*)) AS jaccard FROM x a JOIN x b ON a.shingle = b.shingle AND a.id < b.id GROUP BY a.id, b.id, a.size, b.size HAVING count(*) / (a.size + b.size - count(*)) >= 0.82), c AS (SELECT p.id AS a, h.doc_id AS b, size AS common, 1.0::DOUBLE AS jaccard FROM h JOIN p USING (g) WHERE h.doc_id <> p.id)"


@query("minhash_confirmed_pairs", f"WITH {_JACCARD} SELECT a, b, CAST(common AS BIGINT) AS common, round(jaccard, 6) AS jaccard FROM (SELECT * FROM n UNION ALL SELECT * FROM c)")
def confirmed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.jaccard_pairs(_docs(spark, sf_dir), 0.82).withColumn("jaccard", F.round("jaccard", 6))


@query("duplicate_clusters", f"WITH RECURSIVE {_JACCARD}, e AS (SELECT a, b FROM n UNION SELECT a, b FROM c), adj AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM adj UNION SELECT adj.b, r.root FROM r JOIN adj ON adj.a = r.node) SELECT node, min(root) AS component FROM r GROUP BY node")
def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.jaccard_groups(_docs(spark, sf_dir), 0.82)


@query("cluster_canonical", f"WITH RECURSIVE {_JACCARD}, e AS (SELECT a, b FROM n UNION SELECT a, b FROM c), adj AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM adj UNION SELECT adj.b, r.root FROM r JOIN adj ON adj.a = r.node), k AS (SELECT node, min(root) AS component FROM r GROUP BY node) SELECT component, doc_id AS canonical FROM (SELECT component, doc_id, row_number() OVER (PARTITION BY component ORDER BY length(text) DESC, doc_id) AS r FROM k JOIN documents ON node = doc_id) WHERE r = 1")
def cluster_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return similarity.canonical_of(similarity.jaccard_groups(docs, 0.82), docs)


DELTA = [(1, 2, "retry after 5 s, 3 times", "retry after 30 s, 3 times"), (3, 4, "same 1 text", "other 1 text"), (5, 6, "v 1 2 3 4 5 6 7", "v 2 3 4 5 6 7 8"), (7, 8, "equal 4", "equal 4")]


@query("slot_delta", f"WITH p AS (SELECT * FROM ({values(DELTA)}) t(a, b, ta, tb)), n AS (SELECT a, b, regexp_extract_all(ta, '[0-9]+([.][0-9]+)?') AS x, regexp_extract_all(tb, '[0-9]+([.][0-9]+)?') AS y FROM p WHERE {_HASH.replace('text', 'ta')} = {_HASH.replace('text', 'tb')}), d AS (SELECT a, b, [x[i] || '->' || y[i] FOR i IN range(1, len(x) + 1) IF x[i] <> y[i]] AS c FROM n) SELECT a, b, CASE WHEN len(c) <= 6 THEN c END AS changes FROM d")
def slot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.slot_delta(fixture(spark, DELTA, "a long, b long, text_a string, text_b string"))


_KNN = f"{_VEC}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS r FROM vec), q AS (SELECT *, count(*) OVER (PARTITION BY term) AS n, row_number() OVER (PARTITION BY term ORDER BY round(w, 9) DESC, doc_id) AS hub FROM r WHERE r <= 16), e AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.w * y.w) AS sim FROM q x JOIN q y ON x.term = y.term AND x.doc_id <> y.doc_id WHERE x.n BETWEEN 2 AND 2000 AND (x.n <= 16 OR y.hub <= 8) GROUP BY x.doc_id, y.doc_id)"


@query("lexical_knn", f"WITH {_KNN} SELECT a AS src, b AS dst, round(sim, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS k FROM e WHERE sim >= 0.05) WHERE k <= 12")
def lexical_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    heavy = terms.vectors(_docs(spark, sf_dir), top=16)
    return similarity.knn_edges(similarity.cosine_pairs(heavy)).withColumn("weight", F.round("weight", 6))


@query("overlap_coefficient", "WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM conversations), p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM t) SELECT conv_id, turn, CAST(len(list_intersect(w, v)) AS BIGINT) AS common, round(CASE WHEN least(len(w), len(v)) = 0 THEN 0 ELSE len(list_intersect(w, v)) / least(len(w), len(v)) END, 6) AS overlap FROM p WHERE v IS NOT NULL")
def overlap_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from ..functions import text as T

    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(T.words(F.col("text"))).alias("w"))
    p = t.withColumn("v", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("v IS NOT NULL")
    common, least = F.size(F.array_intersect("w", "v")), F.least(F.size("w"), F.size("v"))
    return p.select("conv_id", "turn", common.cast("long").alias("common"), F.round(F.when(least == 0, 0.0).otherwise(common / least), 6).alias("overlap"))
