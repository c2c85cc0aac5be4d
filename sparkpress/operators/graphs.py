"""Graph operators over edges(src, dst, kind, weight): bounded closures, propagation, PageRank, components, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shared


def adjacency(units: DataFrame, reach: int = 3) -> DataFrame:
    """(src, dst, weight) between units (doc, uid, ord) up to ``reach`` places apart, 0.45 e^(-d/3), both ways."""
    order = Window.partitionBy("doc").orderBy("ord")
    leads = units.select("uid", *[F.lead("uid", d).over(order).alias(f"next{d}") for d in range(1, reach + 1)])
    ahead = leads.select("uid", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"next{d}").alias("next")) for d in range(1, reach + 1)])).alias("x")).where("x.next IS NOT NULL")
    weight = 0.45 * F.exp(-F.col("x.d") / 3.0)
    one = ahead.select(F.col("uid").alias("src"), F.col("x.next").alias("dst"), weight.alias("weight"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def refers(symbols: DataFrame, least: int = 2, most: int = 24) -> DataFrame:
    """(src, dst, weight) between consecutive units of a symbol (name, uid) that least to most units share."""
    unique = symbols.distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("name"))).where(F.col("n").between(least, most))
    after = F.lead("uid").over(Window.partitionBy("name").orderBy("uid"))
    return unique.withColumn("dst", after).where("dst IS NOT NULL").groupBy(F.col("uid").alias("src"), "dst").agg(F.sum(F.lit(0.6)).alias("weight"))


def closure(seeds: DataFrame, edges: DataFrame, horizon: int = 3) -> DataFrame:
    """(uid, depth): what seeds(uid) require within ``horizon`` hops, at the least depth; cycles end by distinctness."""
    reached = seeds.select("uid", F.lit(0).cast("long").alias("depth")).distinct()
    front = reached
    for depth in range(1, horizon + 1):
        front = front.join(edges, front["uid"] == edges["src"]).select(F.col("dst").alias("uid"), F.lit(depth).cast("long").alias("depth")).distinct()
        reached = reached.unionByName(front)
    return reached.groupBy("uid").agg(F.min("depth").alias("depth"))


def violations(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from a kept unit to one that isn't kept."""
    inside = edges.join(kept.select(F.col("uid").alias("src")), "src", "left_semi")
    return inside.join(kept.select(F.col("uid").alias("dst")), "dst", "left_anti").select("src", "dst")


def propagate(levels: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(uid, level): a unit is at least one level below any unit that requires it, over ``rounds`` hops."""
    now = levels
    for _ in range(rounds):
        pushed = edges.join(now, edges["src"] == now["uid"]).groupBy(F.col("dst").alias("uid")).agg((F.max("level") - 1).alias("pushed"))
        now = now.join(pushed, "uid", "left").select("uid", F.greatest("level", F.coalesce("pushed", F.lit(0))).alias("level"))
    return now


def pagerank(units: DataFrame, edges: DataFrame, personal: DataFrame, rounds: int, alpha: float = 0.85) -> DataFrame:
    """(uid, r): personalised PageRank after ``rounds`` steps; mass of units without edges goes to the personalisation.

    The rounds are a fixed, small number, so the whole is one lazy plan.
    """
    base = units.join(personal, "uid", "left").select("uid", F.coalesce("p", F.lit(0.0)).alias("p"))
    mass = base.agg(F.sum("p").alias("mass"))
    base = base.crossJoin(F.broadcast(mass)).select("uid", (F.col("p") / F.col("mass")).alias("p"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    moves = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share"))
    now = base.select("uid", F.col("p").alias("r"), "p")
    for _ in range(rounds):
        gained = moves.join(now, moves["src"] == now["uid"]).groupBy(F.col("dst").alias("uid")).agg(F.sum(F.col("share") * F.col("r")).alias("gain"))
        sent = now.join(out.select(F.col("src").alias("uid")), "uid", "left_semi").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("sent"))
        now = now.join(gained, "uid", "left").crossJoin(F.broadcast(sent)).select("uid", (alpha * (F.coalesce("gain", F.lit(0.0)) + (1 - F.col("sent")) * F.col("p")) + (1 - alpha) * F.col("p")).alias("r"), "p")
    return now.select("uid", "r")


def section_root(parents: DataFrame, depth: int = 12) -> DataFrame:
    """(uid, root): the topmost ancestor of units (uid, parent), by doubling steps, up to 2 ** steps >= depth levels."""
    now = parents.select("uid", F.coalesce("parent", "uid").alias("root"))
    steps = max(1, (depth - 1).bit_length())
    for _ in range(steps):
        above = now.select(F.col("uid").alias("root"), F.col("root").alias("next"))
        now = now.join(above, "root", "left").select("uid", F.coalesce("next", "root").alias("root"))
    return now


def heading_parents(rows: DataFrame) -> DataFrame:
    """(doc, ord, parent): the nearest heading before each row (doc, ord, level; 0 for text) of a lower level."""
    order = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    candidates = []
    for level in range(1, 7):
        last = F.last(F.when(F.col("level") == level, F.col("ord")), ignorenulls=True).over(order)
        # a heading of this level is void once a higher one has come after it
        higher = F.last(F.when((F.col("level") > 0) & (F.col("level") < level), F.col("ord")), ignorenulls=True).over(order)
        candidates.append(F.when(((F.col("level") == 0) | (F.col("level") > level)) & (higher.isNull() | (last > higher)), last))
    return rows.select("doc", "ord", "level", F.greatest(*candidates).alias("parent"))


def orphans(units: DataFrame, parents: DataFrame, depth: int = 8) -> DataFrame:
    """(uid) of live headings without a live descendant that is no heading."""
    chain = parents.where("parent IS NOT NULL").select(F.col("uid"), F.col("parent").alias("ancestor"))
    reach = chain
    for _ in range(max(0, (depth - 1).bit_length())):
        longer = reach.join(reach.select(F.col("uid").alias("ancestor"), F.col("ancestor").alias("top")), "ancestor").select("uid", F.col("top").alias("ancestor"))
        reach = reach.unionByName(longer).distinct()
    supported = reach.join(units.where("live AND NOT heading").select("uid"), "uid", "left_semi").select(F.col("ancestor").alias("uid")).distinct()
    return units.where("live AND heading").join(supported, "uid", "left_anti").select("uid")


def edge_layout(values: DataFrame) -> DataFrame:
    """(doc, uid, place): best values at both ends: odd ranks from the head, even ranks from the tail."""
    part = Window.partitionBy("doc")
    ranked = values.withColumn("r", F.row_number().over(part.orderBy(F.desc("value"), "uid"))).withColumn("n", F.count(F.lit(1)).over(part))
    return ranked.select("doc", "uid", F.when(F.col("r") % 2 == 1, F.floor((F.col("r") + 1) / 2)).otherwise(F.col("n") + 1 - F.floor(F.col("r") / 2)).cast("long").alias("place"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least id that each node with an edge reaches.

    Every round links a node's neighbours to the least id around it, larger ones first and then smaller ones,
    until nothing changes: rounds grow with the logarithm of the longest path, and each is written.
    """
    now = shared.written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        upper = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = upper.join(upper.groupBy("u").agg(F.min("v").alias("m")), "u")
        now = shared.written(lower.select("u", F.col("m").alias("v")).unionByName(lower.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
