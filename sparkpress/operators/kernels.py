"""Order-dependent operators as batch or group kernels: content-defined chunks, log template merging, MMR selection."""

from __future__ import annotations

import difflib
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import profile


def chunks_of(text: str, least: int = 512, average: int = 2048, most: int = 8192) -> list[tuple[int, ...]]:
    """(start, stop) of chunks that end after a line whose digest has enough low zero bits, between least and most characters.

    The bits follow the text's own characters a line, so that chunks are about ``average`` long and an insertion moves only the boundaries near it.
    """
    lines = text.splitlines(keepends=True)
    if not lines:
        return []
    per_chunk = max(1.0, average / max(1.0, len(text) / len(lines)))
    mask = (1 << max(0, round(math.log2(per_chunk)))) - 1
    out, start, at = [], 0, 0
    for line in lines:
        at += len(line)
        digest = int.from_bytes(hashlib.md5(line.encode()).digest()[:4], "big")
        if at - start >= most or (at - start >= least and digest & mask == 0):
            out.append((start, at))
            start = at
    if start < at:
        out.append((start, at))
    return out


def content_chunks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, stop, digest) of each text's chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, a, b, hashlib.md5(t[a:b].encode()).hexdigest()) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, b in chunks_of(t or "")]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], [key, "start", "stop", "digest"])

    return docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, f"{key} long, start long, stop long, digest string")


def merge_templates(templates: DataFrame, least: float = 0.72) -> DataFrame:
    """(mask, level, merged, lines) of exact templates (mask, level, lines): within one length, first word and level a template joins the most frequent one that is similar enough.

    Only templates are compared, never lines, and only inside a bucket, which is one group of the kernel.
    """
    words = F.split("mask", " ")
    keyed = templates.select("mask", F.coalesce("level", F.lit("")).alias("level"), "lines", F.size(words).alias("size"), F.element_at(words, 1).alias("head"))

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (-r["lines"], r["mask"]))
        kept: list[str] = []
        out = []
        for r in rows:
            home = next((k for k in kept if difflib.SequenceMatcher(None, k.split(), r["mask"].split()).ratio() >= least), None)
            if home is None:
                kept.append(r["mask"])
            out.append((r["mask"], r["level"], home or r["mask"], r["lines"]))
        columns = list(zip(*out))
        return pa.table({"mask": pa.array(columns[0]), "level": pa.array(columns[1]), "merged": pa.array(columns[2]), "lines": pa.array(columns[3], pa.int64())})

    return keyed.groupBy("size", "head", "level").applyInArrow(run, "mask string, level string, merged string, lines long")


def log_template_merge(lines: DataFrame) -> DataFrame:
    return merge_templates(profile.log_templates(lines))


def mmr(units: DataFrame, budget: int, trade: float = 0.65, key: str = "doc_id") -> DataFrame:
    """(key, n): sentences (key, n, text, tokens) by maximal marginal relevance to their document, filled to a budget."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("n").to_pydict()
        sets = [set(t or ()) for t in rows["terms"]]
        df: dict[str, int] = {}
        for s in sets:
            for t in s:
                df[t] = df.get(t, 0) + 1
        weight = {t: math.log(1 + len(sets) / c) for t, c in df.items()}
        whole = math.sqrt(sum(w * w * df[t] ** 2 for t, w in weight.items())) or 1.0
        norm = [math.sqrt(sum(weight[t] ** 2 for t in s)) or 1.0 for s in sets]
        relevance = [sum(weight[t] ** 2 * df[t] for t in s) / n / whole for s, n in zip(sets, norm)]
        closest, left, kept = [0.0] * len(sets), budget, []
        open_ = set(range(len(sets)))
        while open_:
            best = max(open_, key=lambda i: (trade * relevance[i] - (1 - trade) * closest[i], -i))
            open_.discard(best)
            if rows["tokens"][best] > left:
                continue
            left -= rows["tokens"][best]
            kept.append(best)
            for i in open_:
                closest[i] = max(closest[i], sum(weight[t] ** 2 for t in sets[i] & sets[best]) / norm[i] / norm[best])
        return pa.table({key: pa.array([rows[key][0]] * len(kept), pa.int64()), "n": pa.array([rows["n"][i] for i in sorted(kept)], pa.int64())})

    given = units.select(key, "n", "tokens", T.content_terms(F.col("text")).alias("terms"))
    return given.groupBy(key).applyInArrow(run, f"{key} long, n long")
