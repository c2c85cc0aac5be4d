"""Near-duplicate detection and term similarity by equi-joins on bands, shingles and terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as T
from . import jaccard_join


def unit_shingles(units: DataFrame, k: int = 4, key: str = "doc_id") -> DataFrame:
    """(key, shingle), distinct."""
    return units.select(key, F.explode(F.array_distinct(T.shingles(F.col("text"), k))).alias("shingle"))


def simhash(units: DataFrame, key: str = "doc_id", bits: int = 60) -> DataFrame:
    """(key, fingerprint): bit majority over the distinct shingles' 60-bit hashes; ties are 0.

    One aggregate of ``bits`` sums a unit: shingles never travel further than their partial sums.
    """
    h = unit_shingles(units, key=key).select(key, T.md5_number(F.col("shingle")).alias("h"))
    votes = h.groupBy(key).agg(*[F.sum(F.when(F.shiftright("h", b).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)).alias(f"b{b}") for b in range(bits)])
    value = None
    for b in range(bits):
        term = F.when(F.col(f"b{b}") > 0, F.lit(1 << b)).otherwise(F.lit(0)).cast("long")
        value = term if value is None else value + term
    return votes.select(key, value.alias("fingerprint"))


def bands(fingerprints: DataFrame, key: str = "doc_id", width: int = 10, count: int = 6) -> DataFrame:
    """(key, band, value): equal bands of a fingerprint (the reference's short seventh band isn't used)."""
    return fingerprints.select(key, F.explode(F.array(*[F.struct(F.lit(b).cast("long").alias("band"), F.shiftright("fingerprint", b * width).bitwiseAND(F.lit((1 << width) - 1)).cast("long").alias("value")) for b in range(count)])).alias("x")).select(key, "x.*")


def minhash(units: DataFrame, slots: int = 16, key: str = "doc_id") -> DataFrame:
    """(key, signature): the least of each slot's linear hash over distinct 3-word shingles."""
    prime = (1 << 31) - 1
    h = unit_shingles(units, 3, key).select(key, (T.md5_number(F.col("shingle")) % prime).alias("h"))
    least = [F.min(((2 * i + 1) * F.col("h") + 7919 * (i + 1)) % prime).alias(f"m{i}") for i in range(slots)]
    return h.groupBy(key).agg(*least).select(key, F.array(*[F.col(f"m{i}") for i in range(slots)]).alias("signature"))


def _hash_words(units: DataFrame, key: str) -> DataFrame:
    """(doc_id, text) with only the words of the hash form: numbers are # there, so digits end a word."""
    return units.select(F.col(key).alias("doc_id"), F.regexp_replace(F.lower("text"), "[^a-z_]+", " ").alias("text"))


def jaccard_pairs(units: DataFrame, threshold: float, k: int = 3, key: str = "doc_id") -> DataFrame:
    """(a, b, common, jaccard) of units whose distinct shingles reach a Jaccard similarity.

    Units with one set are represented by the least id, and listed as (least id, id); all other pairs are
    between least ids.  Exact, by the join of ``jaccard_join``: only packed prefixes and candidates move.
    """
    return jaccard_join.counted_pairs(_hash_words(units, key), k, threshold)


def jaccard_groups(units: DataFrame, threshold: float, k: int = 3, key: str = "doc_id") -> DataFrame:
    """(node, component): the components of ``jaccard_pairs``, which aren't listed for them."""
    return jaccard_join.groups(_hash_words(units, key), k, threshold)


def canonical_of(groups: DataFrame, units: DataFrame, key: str = "doc_id") -> DataFrame:
    """(component, canonical): the longest unit of each group, the least id first."""
    order = Window.partitionBy("component").orderBy(F.desc("chars"), key)
    size = units.select(key, F.length("text").alias("chars"))
    return groups.join(size, groups["node"] == size[key]).withColumn("r", F.row_number().over(order)).where("r = 1").select("component", F.col(key).alias("canonical"))


def slot_delta(pairs: DataFrame) -> DataFrame:
    """(a, b, changes) of pairs (a, b, text_a, text_b) with one hash form: the numbers that differ, in place; at most six, else null."""
    numbers = lambda c: T.matches(F.col(c), "[0-9]+([.][0-9]+)?")
    same = pairs.where(T.hash_form(F.col("text_a")) == T.hash_form(F.col("text_b")))
    zipped = F.filter(F.arrays_zip(numbers("text_a").alias("x"), numbers("text_b").alias("y")), lambda z: z["x"] != z["y"])
    return same.withColumn("d", zipped).select("a", "b", F.when(F.size("d") <= 6, F.transform("d", lambda z: F.concat(z["x"], F.lit("->"), z["y"]))).alias("changes"))


def cosine_pairs(heavy: DataFrame, max_postings: int = 2000, hubs_from: int = 16, hubs: int = 8, key: str = "doc_id") -> DataFrame:
    """(a, b, sim) over (key, term, w), each unit's heaviest terms.

    A term with more than ``hubs_from`` postings links its units to the ``hubs`` heaviest only, so a term's
    pairs grow linearly with its postings; a term beyond ``max_postings`` links none.
    """
    # written: the texts are read once; counted first, so that no term's window holds more than max_postings
    heavy = shared.written(heavy.select(key, "term", "w"), "heavy")
    some = heavy.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, max_postings))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc(F.round("w", 9)), key))
    post = heavy.join(some, "term").withColumn("hub", rank).select("term", F.col(key).alias("u"), "w", "n", "hub")
    left = post.select("term", F.col("u").alias("a"), F.col("w").alias("wa"), "n")
    right = post.select("term", F.col("u").alias("b"), F.col("w").alias("wb"), "hub")
    pairs = left.join(right, "term").where((F.col("a") != F.col("b")) & ((F.col("n") <= hubs_from) | (F.col("hub") <= hubs)))
    return pairs.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))


def knn_edges(pairs: DataFrame, k: int = 12, least: float = 0.05) -> DataFrame:
    """(src, dst, weight): each unit's k most similar units."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("sim", 9)), "b"))
    return pairs.where(F.col("sim") >= least).withColumn("r", rank).where(F.col("r") <= k).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("sim").alias("weight"))
