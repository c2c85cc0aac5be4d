"""Budgeted selection: coverage objective, water-filling, lazy greedy. Kernels work on one request's units at a time."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def waterfill(value: np.ndarray, cap: np.ndarray, budget: float, floor: np.ndarray | None = None) -> np.ndarray:
    """Shares of a budget among documents that maximise sum v log(1 + b / k), k = max(1, cap / 8), between floor and cap; bisection on the common price."""
    floor = np.zeros_like(cap) if floor is None else np.minimum(floor, cap)
    if budget >= cap.sum():
        return cap.copy()
    kappa = np.maximum(1.0, cap / 8)
    share = lambda price: np.clip(value / price - kappa, floor, cap)
    low, high = 1e-12, max(1e-9, float((value / kappa).max())) * 2
    for _ in range(80):
        middle = math.sqrt(low * high)
        low, high = (middle, high) if share(middle).sum() > budget else (low, middle)
    return share(high)


def coverage_gain(covered: dict[str, float], parts: list[tuple[str, float]], weight: dict[str, float], rate: float) -> float:
    return sum(weight[t] * (math.exp(-rate * covered.get(t, 0.0)) - math.exp(-rate * (covered.get(t, 0.0) + d))) for t, d in parts)


def lazy_greedy(cost: list[int], parts: list[list[tuple[str, float]]], weight: dict[str, float], budget: int, locked: list[bool], stop: float, rate: float = 0.9, locked_budget: int | None = None) -> list[int]:
    """Units to keep: locked ones first, within a budget of their own, then by gain per token with lazy re-evaluation, while the gain per token is at least ``stop`` of the first; or the best single unit where that covers more."""
    covered: dict[str, float] = {}
    chosen, left = [], budget

    def take(i: int) -> None:
        nonlocal left
        chosen.append(i)
        left -= cost[i]
        for t, d in parts[i]:
            covered[t] = covered.get(t, 0.0) + d

    for i in sorted((i for i, held in enumerate(locked) if held), key=lambda i: (cost[i], i)):
        if cost[i] <= (locked_budget if locked_budget is not None else budget) - (budget - left):
            take(i)
    fixed = len(chosen)
    before = dict(covered)
    room = left
    heap = [(-coverage_gain(covered, parts[i], weight, rate) / max(1, cost[i]), i) for i in range(len(cost)) if i not in set(chosen)]
    heapq.heapify(heap)
    first = None
    while heap:
        _, i = heapq.heappop(heap)
        if cost[i] > left:
            continue
        gain = coverage_gain(covered, parts[i], weight, rate) / max(1, cost[i])
        if heap and gain < -heap[0][0] - 1e-15:
            heapq.heappush(heap, (-gain, i))
            continue
        first = gain if first is None else first
        if gain <= 0 or gain < stop * first:
            break
        take(i)
    value = lambda held: sum(weight[t] * (1 - math.exp(-rate * x)) for t, x in held.items())
    greedy = value(covered)
    best, best_value = None, greedy
    for i in range(len(cost)):
        if i not in chosen[:fixed] and cost[i] <= room:
            alone = value(before) + coverage_gain(before, parts[i], weight, rate)
            if alone > best_value + 1e-12:
                best, best_value = i, alone
    return sorted(chosen if best is None else [*chosen[:fixed], best])


def select_units(units: DataFrame, saturation: float, stop: float, key: str = "doc_id") -> DataFrame:
    """(key, n) of the units kept, from (key, n, tokens, budget, critical_budget, locked, salience, terms: array of (term, w))."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("n").to_pydict()
        parts = [[(x["term"], 1.0) for x in ts or ()] for ts in rows["terms"]]
        weight: dict[str, float] = {}
        for ts, salience in zip(rows["terms"], rows["salience"]):
            for x in ts or ():
                weight[x["term"]] = max(weight.get(x["term"], 0.0), x["w"] * (0.5 + (salience or 0.0)))
        kept = lazy_greedy(rows["tokens"], parts, weight, rows["budget"][0], rows["locked"], stop, saturation, rows["critical_budget"][0])
        return pa.table({key: pa.array([rows[key][0]] * len(kept), pa.int64()), "n": pa.array([rows["n"][i] for i in kept], pa.int64())})

    return units.groupBy(key).applyInArrow(run, f"{key} long, n long")


def head_and_tail(units: DataFrame, budget_share: float, key: str = "doc_id") -> DataFrame:
    """(key, n, place): units that fit when a text is cut to a share of its tokens from the head, the tail, or both."""
    part = Window.partitionBy(key)
    total = F.sum("tokens").over(part)
    ahead = F.sum("tokens").over(part.orderBy("n"))
    behind = F.sum("tokens").over(part.orderBy(F.desc("n")))
    budget = F.floor(total * budget_share)
    flags = units.select(key, "n", (ahead <= budget).alias("head"), (behind <= budget).alias("tail"), ((ahead <= budget / 2) | (behind <= budget / 2)).alias("both"))
    return flags.select(key, "n", F.explode(F.array_compact(F.array(F.when(F.col("head"), "head"), F.when(F.col("tail"), "tail"), F.when(F.col("both"), "middle")))).alias("place"))


def running_fill(ranked: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """(key, n): units in order of score while their running tokens stay within the budget."""
    used = F.sum("tokens").over(Window.partitionBy(key).orderBy(F.desc("score"), "n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("used", used).where(F.col("used") <= budget).select(key, "n")
