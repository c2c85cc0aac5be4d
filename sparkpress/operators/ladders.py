"""Ladders of a unit's versions, protection, dependencies, and what selection and rendering need of them; all relational."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text as T
from . import lines

#: Protection levels, weakest first.
LEVELS = ["droppable", "anchored", "locked", "frozen"]
ROLES = {"system": "frozen", "tools": "frozen", "instruction": "frozen", "query": "frozen", "example": "locked"}
KINDS = {"header": "locked", "parameter": "locked", "ddl": "locked", "heading": "anchored", "definition": "anchored", "status": "anchored"}


def tighten(text: Column) -> Column:
    """Without hedges, short parentheses that state nothing, and fillers; single spaces, a capital first letter. A text with a constraint or a negation stays."""
    fillers = r"(?i)\b(" + "|".join(lexicon.FILLERS) + r")\b,? ?"
    bare = T.replaced(T.replaced(T.replaced(text, lexicon.HEDGE + ",? ?", ""), r" ?[(][A-Za-z ,]{1,40}[)]", ""), fillers, "")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.when(T.has(text, lexicon.STRONG) | T.has(text, lexicon.NEGATION) | (bare == ""), text).otherwise(F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 1 << 30)))


def carriers(docs: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): only the sentences that a protected span (key, start, stop) touches; of texts of two sentences or more, where that saves a fifth."""
    s = lines.sentence_offsets(docs, key)
    held = s.join(spans.select(key, F.col("start").alias("from"), F.col("stop").alias("to")), key).where("start < to AND from < stop").select(key, "n", "sentence").distinct()
    kept = held.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))
    size = s.groupBy(key).agg(F.count(F.lit(1)).alias("sentences")).join(docs.select(key, F.length("text").alias("chars")), key)
    return kept.join(size, key).where((F.col("sentences") > 1) & (F.length("text") < 0.8 * F.col("chars"))).select(key, "text")


def protection(role: Column, kind: Column, text: Column) -> Column:
    """Number of a unit's level: the greatest of what its role, kind and phrases ask for."""
    level = lambda names: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in names[1].items() for x in (k, LEVELS.index(v))]), names[0]), F.lit(0))
    phrase = F.when(T.has(text, lexicon.STRONG) | T.has(text, lexicon.SECURITY), 2).when(T.has(text, lexicon.NEGATION), 1).otherwise(0)
    return F.greatest(level((role, ROLES)), level((kind, KINDS)), phrase).cast("long")


def anchor_operands(units: DataFrame, computing: Column) -> DataFrame:
    """protection of prose units with a number is 1 at least where the request computes something."""
    asked = computing & (F.col("kind") == "prose") & F.col("text").rlike("[0-9]")
    return units.withColumn("protection", F.when(asked, F.greatest("protection", F.lit(1).cast("long"))).otherwise(F.col("protection")))


def ladder(units: DataFrame) -> DataFrame:
    """(uid, rung, name, text, tokens) of units (uid, text): drop, tight where it saves more than a token of twelve or more, full; fewest tokens first."""
    full = units.select("uid", "text", T.token_count(F.col("text")).alias("tokens"))
    tight = full.where("tokens >= 12").select("uid", tighten(F.col("text")).alias("text"), F.col("tokens").alias("whole")).withColumn("tokens", T.token_count(F.col("text"))).where("tokens < whole - 1").drop("whole")
    drop = full.select("uid", F.lit("").alias("text"), F.lit(0).cast("long").alias("tokens"))
    named = [df.select("uid", F.lit(name).alias("name"), "text", "tokens") for name, df in (("drop", drop), ("tight", tight), ("full", full))]
    rung = F.row_number().over(Window.partitionBy("uid").orderBy("tokens", F.col("name") != "drop", F.col("name") == "full")) - 1
    return reduce(DataFrame.unionByName, named).select("uid", rung.cast("long").alias("rung"), "name", "text", "tokens")


def admissible(rungs: DataFrame) -> DataFrame:
    """Add whether a rung's facts hold all its unit's facts."""
    return rungs.withColumn("admissible", F.size(F.array_except("unit_facts", "rung_facts")) == 0)


def least_rung(rungs: DataFrame) -> DataFrame:
    """(uid, least): 0 for droppable units, the first rung with text for anchored ones, the first that holds all facts for locked ones, the last for frozen ones."""
    p, last = F.col("protection"), F.max("rung")
    agg = rungs.groupBy("uid", "protection").agg(F.min(F.when(F.col("rung") > 0, F.col("rung"))).alias("some"), F.min(F.when(F.col("admissible") & (F.col("rung") > 0), F.col("rung"))).alias("whole"), last.alias("last"))
    return agg.select("uid", F.when(p == 0, 0).when(p == 1, F.coalesce("some", "last")).when(p == 2, F.coalesce("whole", "last")).otherwise(F.col("last")).cast("long").alias("least"))


def contributions(rungs: DataFrame) -> DataFrame:
    """(uid, rung, concept, amount): the distinct terms of a rung's text, and one for each of its facts."""
    term = rungs.select("uid", "rung", F.explode(F.array_distinct(T.content_terms(F.col("text")))).alias("concept"))
    fact = rungs.select("uid", "rung", F.explode("rung_facts").alias("f")).select("uid", "rung", F.concat(F.lit("@fact:"), F.col("f")).alias("concept"))
    return term.unionByName(fact).withColumn("amount", F.lit(1.0))


def retained(chosen: DataFrame, rungs: DataFrame) -> DataFrame:
    """(fact): facts of the chosen (uid, rung)."""
    return rungs.join(chosen, ["uid", "rung"]).select(F.explode("rung_facts").alias("fact")).distinct()


def promote(chosen: DataFrame, requires: DataFrame) -> DataFrame:
    """(uid, rung): what chosen units require directly is raised to its first rung with text."""
    needed = requires.join(chosen.where("rung > 0"), requires["src"] == chosen["uid"]).select(F.col("dst").alias("uid"), F.lit(1).cast("long").alias("rung"))
    return chosen.unionByName(needed).groupBy("uid").agg(F.max("rung").alias("rung"))


def live_canonicals(chosen: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(uid, rung): the canonical of a kept duplicate (uid, canonical) is kept too."""
    return promote(chosen, duplicates.select(F.col("uid").alias("src"), F.col("canonical").alias("dst")))


def personalisation(units: DataFrame, query_weight: float = 1.6, recency_weight: float = 0.25) -> DataFrame:
    """(uid, p) of (uid, role, protection, hit, place 0..1): where a walk restarts; sums to 1."""
    # the multiples are those of the written number: in binary 3 * 1.6 is not 4.8, which moved shares that end in a half
    edge = F.abs(2 * F.col("place") - 1)
    raw = 0.05 + F.when(F.col("role") == "query", float(2 * Decimal(str(query_weight)))).otherwise(0.0) + F.when(F.col("protection") >= 2, 0.8).when(F.col("protection") == 1, 0.3).otherwise(0.0) + float(3 * Decimal(str(query_weight))) * F.col("hit") + 0.25 * edge + recency_weight * F.col("place")
    return units.select("request", "uid", raw.alias("p")).withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("request")))


def attention(ranks: DataFrame) -> DataFrame:
    """(request, uid, attention) of (request, uid, rank, tokens): rank over the request's peak, less for long units, scaled to 1."""
    of = Window.partitionBy("request")
    raw = F.col("rank") / F.max("rank").over(of) / F.sqrt(F.greatest(F.lit(1.0), F.col("tokens") / 24))
    return ranks.withColumn("raw", raw).select("request", "uid", (F.col("raw") / F.max("raw").over(of)).alias("attention"))


def dedup_candidates(units: DataFrame, least: int = 2, most: int = 40_000) -> DataFrame:
    """Units that may be compared: not frozen, eight tokens or more, of no structural kind; requests with too few or too many have none."""
    some = units.where((F.col("protection") < 3) & (F.col("tokens") >= 8) & ~F.col("kind").isin("heading", "header", "import", "schema"))
    return some.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("request"))).where(F.col("c").between(least, most)).drop("c")


def fact_tiers(found: DataFrame) -> DataFrame:
    """(fact, weight, tier) of (fact, class, weight, superseded, prose) a row an owner: owned by superseded units only, weight 0.01; critical, or owned by prose, tier 1, else 2."""
    critical = F.col("class").isin("security", "constraint", "negation")
    agg = found.groupBy("fact").agg(F.max("weight").alias("weight"), F.bool_and("superseded").alias("gone"), F.bool_or(critical | F.col("prose")).alias("first"))
    return agg.select("fact", F.when(F.col("gone"), 0.01).otherwise(F.col("weight")).alias("weight"), F.when(F.col("first"), 1).otherwise(2).cast("long").alias("tier"))


def symbols(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """(name, n, units): identifiers of three characters or more, how often and in which units they occur."""
    found = units.where(F.length("text") < 4000).select(key, F.explode(T.matches(F.col("text"), dict((c, p) for c, _, _, p in lexicon.LITERALS)["identifier"])).alias("name")).where(F.length("name") >= 3)
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(key)).alias("units"))


def cross_references(units: DataFrame) -> DataFrame:
    """(src, dst) of clauses (doc, uid, number, text): 'section 4.2' points at the first clause of that number in its document."""
    asked = units.select("doc", F.col("uid").alias("src"), F.explode(F.array_distinct(F.transform(T.matches(F.lower("text"), "(section|clause|article) [0-9]+([.][0-9]+)*"), lambda m: F.element_at(F.split(m, " "), 2)))).alias("number"))
    first = units.where("number IS NOT NULL").groupBy("doc", "number").agg(F.min("uid").alias("dst"))
    return asked.join(first, ["doc", "number"]).where("src <> dst").select("src", "dst")


def row_headers(rows: DataFrame) -> DataFrame:
    """(src, dst): each row of a table (doc, block, uid, n) requires the first."""
    head = F.first("uid").over(Window.partitionBy("doc", "block").orderBy("n"))
    return rows.select(F.col("uid").alias("src"), head.alias("dst")).where("src <> dst")
