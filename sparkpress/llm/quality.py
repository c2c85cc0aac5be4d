"""Operator 9, quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a text: its words hashed to ``CELLS`` cells, weighted by count and
scaled to unit length; standardised structure statistics of its bytes and words;
one cell each for its language and source.  The score is

    w0 + sum w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ],

the sum-of-squares form of all pairwise interactions of rank ``RANK``, linear in
the number of features.  Training is stochastic gradient descent (Adam) with
balanced classes on the driver, on at most ``TRAIN_ROWS`` labelled documents:
those with the least hash of their id, so the bound doesn't depend on the
input's order or size.  Scoring covers every row and every word of it.

With ``reject_toxic``, as in the query and the pipeline, a second output is the
probability that a text is toxic: naive Bayes over the presence of words that
alone make a labelled text likelier toxic than not, and do so significantly: at
most ``CHANCE`` of all words would pass by chance.  The machine's words can't do it: scaled to unit length, one insult
in a long text is next to nothing.  ``score`` alone leaves toxicity to its caller.

Result: (doc_id, score, accepted): the probability that the text is good (and not
toxic), and whether it reaches ``threshold``.

Defined cases: a null, empty or word-less text scores 0.0 and isn't accepted;
null languages and sources have a cell of their own; labels with a null id or
quality are ignored, those without a quality still teach toxicity and those
without toxicity quality; of several labels of one id the worst counts; without labels of both kinds every text that has words
scores 1.0; repeated rows are scored alike and stay; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

CELLS, RANK = 1 << 14, 8
LANG_CELLS, SOURCE_CELLS = 32, 128
TRAIN_ROWS, EPOCHS, RATE, THRESHOLD = 12_000, 12, 0.02, 0.5
CHANCE = 1
STATS = ["log_bytes", "log_words", "word_bytes", "upper", "digit", "punctuation", "non_ascii", "distinct", "top_word", "stutter", "lines", "marks"]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "punctuation": np.isin(np.arange(256), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]),
    "non_ascii": np.arange(256) > 127,
    "lines": np.arange(256) == 10,
    "marks": np.isin(np.arange(256), np.frombuffer(b"!|#$%&*<>~^", np.uint8)),
}
STAT0, LANG0 = CELLS, CELLS + len(STATS)
SOURCE0 = LANG0 + LANG_CELLS
WIDTH = SOURCE0 + SOURCE_CELLS


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each text, feature numbers, values, words of each text, hash and text of each word); statistics aren't standardised yet."""
    rows = len(offsets) - 1
    hashed, doc, _, length = K.words(_LOWER[data], offsets)
    count = np.bincount(doc, minlength=rows)
    key = doc * CELLS + (hashed & np.uint64(CELLS - 1)).astype(np.int64)
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(new, append=len(key)).astype(np.float32)
    owner, cell = key[new] // CELLS, key[new] % CELLS
    norm = np.sqrt(np.bincount(owner, times**2, rows))
    kinds = np.bincount(owner, minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, owner, times)
    words = np.maximum(count, 1)
    bytes_ = np.maximum(np.diff(offsets), 1)
    repeat = np.zeros(len(hashed), bool)
    repeat[1:] = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
    stats = {"log_bytes": np.log1p(np.diff(offsets)), "log_words": np.log1p(count), "word_bytes": np.bincount(doc, length, rows) / words, "distinct": kinds / words, "top_word": top / words, "stutter": np.bincount(doc, repeat, rows) / words}
    stats |= {name: _sums(table[data], offsets) / bytes_ for name, table in _CLASS.items()}
    dense = np.stack([stats[s] for s in STATS], 1)
    per = kinds + len(STATS) + 2
    start = np.concatenate([[0], np.cumsum(per)])
    number, value = np.empty(start[-1], np.int64), np.empty(start[-1], np.float32)
    at = np.arange(len(owner)) + (start[:-1] - (np.cumsum(kinds) - kinds))[owner]
    number[at], value[at] = cell, times / norm[owner]
    tail = (start[1:] - len(STATS) - 2)[:, None] + np.arange(len(STATS) + 2)
    number[tail] = np.concatenate([np.broadcast_to(STAT0 + np.arange(len(STATS)), dense.shape), (LANG0 + lang)[:, None], (SOURCE0 + source)[:, None]], 1)
    value[tail] = np.concatenate([dense, np.ones((rows, 2))], 1)
    return start, number, value, count, hashed, doc


class Machine:
    """Weights of a factorisation machine, with the statistics' means and deviations."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = 7):
        self.mean, self.deviation = mean, deviation
        self.w0 = np.zeros(1)
        self.w = np.zeros(WIDTH)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (WIDTH, RANK))

    def scale(self, number: np.ndarray, value: np.ndarray) -> np.ndarray:
        s = (number >= STAT0) & (number < LANG0)
        value = value.astype(np.float64)
        i = number[s] - STAT0
        value[s] = np.clip((value[s] - self.mean[i]) / self.deviation[i], -4, 4)
        return value

    def margins(self, start: np.ndarray, number: np.ndarray, value: np.ndarray) -> np.ndarray:
        vx = self.v[number] * value[:, None]
        pair = np.add.reduceat(vx, start[:-1]) ** 2 - np.add.reduceat(vx * vx, start[:-1])
        return self.w0[0] + np.add.reduceat(self.w[number] * value, start[:-1]) + pair.sum(1) / 2

    def fit(self, start: np.ndarray, number: np.ndarray, value: np.ndarray, good: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, batch: int = 256, l2: float = 1e-5) -> None:
        value = self.scale(number, value)
        share = np.clip(good.mean(), 1e-6, 1 - 1e-6)
        weight = np.where(good == 1, 0.5 / share, 0.5 / (1 - share))
        rng, step = np.random.default_rng(11), 0
        parts = (self.w0, self.w, self.v)
        first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        for _ in range(epochs):
            order = rng.permutation(len(good))
            for s in range(0, len(order), batch):
                rows = order[s : s + batch]
                size = np.diff(start)[rows]
                at = np.concatenate([np.arange(start[r], start[r + 1]) for r in rows])
                begin = np.concatenate([[0], np.cumsum(size)])
                n, x = number[at], value[at]
                d = (1 / (1 + np.exp(-self.margins(begin, n, x))) - good[rows]) * weight[rows] / len(rows)
                each = np.repeat(d, size) * x
                sums = np.repeat(np.add.reduceat(self.v[n] * x[:, None], begin[:-1]), size, axis=0)
                used, inverse = np.unique(n, return_inverse=True)
                gv = np.zeros((len(used), RANK))
                for f in range(RANK):
                    gv[:, f] = np.bincount(inverse, each * (sums[:, f] - self.v[n, f] * x), len(used))
                step += 1
                for p, m, q, where, g in zip(parts, first, second, (np.zeros(1, int), used, used), (np.array([d.sum()]), np.bincount(inverse, each, len(used)) + l2 * self.w[used], gv + l2 * self.v[used])):
                    m[where] = 0.9 * m[where] + 0.1 * g
                    q[where] = 0.999 * q[where] + 0.001 * g * g
                    p[where] -= rate * (m[where] / (1 - 0.9**step)) / (np.sqrt(q[where] / (1 - 0.999**step)) + 1e-8)


class Insults:
    """Words that tell toxic texts, and the log odds of toxic by their presence and absence."""

    def __init__(self, words: np.ndarray, owner: np.ndarray, toxic: np.ndarray):
        """words, owner: distinct words of each text."""
        names, inverse = np.unique(words, return_inverse=True)
        many, few = toxic.sum(), (1 - toxic).sum()
        bad = np.bincount(inverse, toxic[owner], len(names))
        fine = np.bincount(inverse, minlength=len(names)) - bad
        log = lambda x: np.log(np.maximum(x, 1e-12))
        rows, seen = many + few, bad + fine
        gain = 2 * sum(n * log(n * rows / np.maximum(total * kind, 1)) for n, total, kind in ((bad, seen, many), (fine, seen, few), (many - bad, rows - seen, many), (few - fine, rows - seen, few)))
        tells = (bad > fine) & (gain > 2 * np.log(len(names) / CHANCE)) & (bad * few > fine * many)
        self.words = names[tells]
        p, q = (bad[tells] + 0.5) / (many + 1), (fine[tells] + 0.5) / (few + 1)
        self.base = np.log(many / few) + np.log((1 - p) / (1 - q)).sum()
        self.weight = np.log(p / q) - np.log((1 - p) / (1 - q))

    def probability(self, hashed: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
        if not len(self.words):
            return np.zeros(rows)
        at = np.minimum(np.searchsorted(self.words, hashed), len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == hashed)
        pair = np.unique(doc[hit] * len(self.words) + at[hit])
        odds = self.base + np.bincount(pair // len(self.words), self.weight[pair % len(self.words)], rows)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _cell(column: str, cells: int) -> Column:
    return F.when(F.col(column).isNull(), 0).otherwise(F.pmod(F.xxhash64(column), F.lit(cells - 1)) + 1).cast("int")


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _cell("lang", LANG_CELLS).alias("lang_cell"), _cell("source", SOURCE_CELLS).alias("source_cell"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple]]:
    lang, source = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
    for a, b, data, offsets in K.blocks(batch.column(1), max_docs=4096):
        yield a, b, features(data, offsets, lang[a:b], source[a:b])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, reject_toxic: bool = False) -> tuple[Machine | None, Insults | None]:
    """A machine and insults fitted to the labelled documents of least hash; None for one whose labels aren't of both kinds."""
    if not reject_toxic:
        labels = labels.withColumn("toxic", F.lit(None).cast("int"))
    labelled = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).select(F.col("doc_id").alias("label_id"), "quality", "toxic")
    inputs = _inputs(docs).where("text IS NOT NULL")
    found = inputs.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "lang_cell", "source_cell", "quality", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, (start, number, value, count, hashed, _) in _blocks(batch):
                cut = [slice(start[i], start[i + 1]) for i in range(b - a)]
                words = np.split(hashed, np.cumsum(count)[:-1]) if reject_toxic else [hashed[:0]] * (b - a)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 4, 5)), *(pa.array(x, pa.binary()) for x in ([number[c].astype(np.int32).tobytes() for c in cut], [value[c].tobytes() for c in cut], [np.unique(w).tobytes() for w in words]))], ["doc_id", "quality", "toxic", "numbers", "cells", "words"])

    rows = found.mapInArrow(run, "doc_id long, quality int, toxic int, numbers binary, cells binary, words binary").toArrow()
    rows = rows.take(pa.compute.sort_indices(rows["doc_id"]))
    machine = _machine(rows.select(["quality", "numbers", "cells"]).filter(rows["quality"].is_valid()))
    rows = rows.select(["toxic", "words"])
    K.release()
    insults = _insults(rows.filter(rows["toxic"].is_valid()))
    del rows
    K.release()
    return machine, insults


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(elements one after another, elements of each row) of binary arrays, without a copy for each row."""
    whole = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    _, offsets, data = whole.buffers()
    offsets = np.frombuffer(offsets, np.int32)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def _machine(rows: pa.Table) -> Machine | None:
    good = (rows["quality"].to_numpy() > 0).astype(np.float64)
    if not rows.num_rows or good.min() == good.max():
        return None
    number, per = _flat(rows["numbers"], np.int32)
    value, _ = _flat(rows["cells"], np.float32)
    start = np.concatenate([[0], np.cumsum(per)])
    stats = np.stack([value[number == STAT0 + i] for i in range(len(STATS))], 1).astype(np.float64)
    machine = Machine(stats.mean(0), np.maximum(stats.std(0), 1e-6))
    machine.fit(start, number, value, good)
    return machine


def _insults(rows: pa.Table) -> Insults | None:
    toxic = (rows["toxic"].to_numpy() > 0).astype(np.float64)
    if not rows.num_rows or toxic.min() == toxic.max():
        return None
    words, per = _flat(rows["words"], np.uint64)
    return Insults(words, np.repeat(np.arange(len(per)), per), toxic)


def _probability(fitted: tuple[Machine | None, Insults | None], start: np.ndarray, number: np.ndarray, value: np.ndarray, count: np.ndarray, hashed: np.ndarray, doc: np.ndarray) -> np.ndarray:
    machine, insults = fitted
    p = np.ones(len(count)) if machine is None else 1 / (1 + np.exp(-np.clip(machine.margins(start, number, machine.scale(number, value)), -500, 500)))
    if insults is not None:
        p = p * (1 - insults.probability(hashed, doc, len(count)))
    return np.where(count > 0, p, 0.0)


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, reject_toxic: bool = False) -> DataFrame:
    """(doc_id, score, accepted) for every row of docs."""
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_rows, reject_toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found in _blocks(batch):
                p = _probability(machine.value, *found)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p), pa.array(p >= threshold)], ["doc_id", "score", "accepted"])

    return _inputs(docs).mapInArrow(run, "doc_id long, score double, accepted boolean")


def accepted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, reject_toxic: bool = True) -> DataFrame:
    """The accepted rows of docs with all their columns; each row is judged by its own text, in one pass without a join."""
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_rows, reject_toxic))
    inner = ["doc_id", "text", "lang_cell", "source_cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for a, b, found in _blocks(pa.RecordBatch.from_arrays(batch.columns[-len(inner) :], inner)):
                keep[a:b] = _probability(machine.value, *found) >= threshold
            kept = batch.filter(pa.array(keep))
            K.release()
            yield pa.RecordBatch.from_arrays(kept.columns[: -len(inner)], kept.schema.names[: -len(inner)])

    given = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text"), _cell("lang", LANG_CELLS).alias("__lang"), _cell("source", SOURCE_CELLS).alias("__source"))
    return given.mapInArrow(run, docs.schema)
