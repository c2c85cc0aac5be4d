"""Operator 6, LM scoring: a hidden Markov language model over words.

Every word of the corpus has its own emission probabilities; nothing is cut off
or lumped together.  The model has ``STATES`` latent states.

1. **Words.**  One pass over the texts writes each task's texts as numbers into
   its blocks' word lists, and the counts of its distinct words.  Counts and
   emissions are split by ranges of word hashes into as many buckets as there are
   shuffle partitions: a bucket adds up what all tasks say of its words, and sends
   each task the values of the words it has.  So no task and no driver ever holds
   the vocabulary, and what is gathered grows with the input.
2. **Training** is Baum-Welch: each task runs scaled forward and backward
   recursions over its texts and sums expected counts (starts, transitions,
   emissions of its words), which the buckets add up and normalise.  Rounds go
   over all texts until one raises the corpus' log-likelihood by less than
   ``TOLERANCE`` of it, and by no more than the round before (a start may be flat).
   The first starts from corpus word frequencies, perturbed by a hash of (word,
   state), and from persistent states.  The history is logged.
3. **Scoring** is the scaled forward recursion: the logarithm of the exact
   likelihood of the whole word sequence of a text, summed over all state paths.

Texts of a block are run side by side, longest first, one step for the next word
of all that still have one.

Result: (doc_id, n_words, log_likelihood, perplexity) for every row.

Defined cases: a null, empty or word-less text has 0 words, log-likelihood 0.0
and null perplexity, and doesn't train; repeated rows count and are scored as
often as they occur; null ids are kept; words of equal counts differ only by their
hashes; a very long text is run whole, in about 150 bytes of memory a word; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from . import textkernel as K

STATES = 6
TOLERANCE = 1e-3
#: Bytes of text in a written block, and words that are run at once.
BLOCK, TOGETHER = 4_000_000, 1_200_000
FLOOR = 1e-3
#: How likely a state is to last, at the start of training.
PERSIST = 0.95


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # (states), (states, states), (words, states)

    @staticmethod
    def noise(names: np.ndarray, states: int) -> np.ndarray:
        """A factor from 0.5 to 1.5 for each word and state."""
        return 0.5 + K.mix(names[:, None] + np.arange(1, states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) / 2.0**64

    @staticmethod
    def first(states: int) -> tuple[np.ndarray, np.ndarray]:
        """Even starts, and states that tend to last."""
        move = np.full((states, states), (1 - PERSIST) / max(1, states - 1)) if states > 1 else np.ones((1, 1))
        np.fill_diagonal(move, PERSIST if states > 1 else 1.0)
        return np.full(states, 1 / states), move


def _packed(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words step by step, texts active at each step, order of texts): texts longest first."""
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    length = counts[order]
    steps = int(length[0]) if len(order) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")  # texts with more than t words
    first = (np.cumsum(counts) - counts)[order]
    begin = np.cumsum(active) - active
    step = np.repeat(np.arange(steps), active)
    at = first[np.arange(len(step)) - np.repeat(begin, active)] + step
    return words[at], active, order


def forward(model: Model, words: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scaled alphas, scales, emissions), one row for each word, step by step."""
    emit = model.emit[words]
    start, move = model.start.astype(emit.dtype), model.move.astype(emit.dtype)
    alpha, scale = np.empty_like(emit), np.empty(len(words))
    begin = 0
    for t, n in enumerate(active.tolist()):
        here = alpha[begin : begin + n]
        if t:
            np.dot(alpha[previous : previous + n], move, out=here)  # noqa: F821
            here *= emit[begin : begin + n]
        else:
            np.multiply(emit[:n], start, out=here)
        s = here.sum(1)
        here /= s[:, None]
        scale[begin : begin + n] = s
        previous, begin = begin, begin + n
    return alpha, scale, emit


def expected(model: Model, words: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, transitions and emissions, and the log-likelihood."""
    alpha, scale, emit = forward(model, words, active)
    states = len(model.start)
    emit /= scale[:, None].astype(emit.dtype)
    beta = np.ones_like(alpha)
    begins = np.cumsum(active) - active
    counts, moved = active.tolist(), begins.tolist()
    back = np.ascontiguousarray(model.move.T.astype(emit.dtype))
    for t in range(len(counts) - 1, 0, -1):
        n, b = counts[t], moved[t]
        weighted = emit[b : b + n]
        weighted *= beta[b : b + n]  # kept: the transitions need it
        np.dot(weighted, back, out=beta[moved[t - 1] : moved[t - 1] + n])
    move = np.zeros((states, states))
    if len(counts) > 1:
        # rows of step t (first n of them) against rows of step t + 1
        later = np.arange(counts[0], len(words))
        step = np.repeat(np.arange(1, len(counts)), active[1:])
        earlier = later - begins[step] + begins[step - 1]
        move = model.move * (alpha[earlier].T @ emit[later]).astype(np.float64)
    alpha *= beta
    gamma = alpha
    start = gamma[: counts[0]].sum(0, dtype=np.float64) if counts else np.zeros(states)
    table = np.stack([np.bincount(words, gamma[:, k], len(model.emit)) for k in range(states)], 1)
    return start, move, table, float(np.log(scale).sum())


_BLOCKS = "task int, part int, docs binary, known binary, counts binary, names binary, words binary"
_SENT = "bucket int, task int, names binary, values binary"
_BACK = "task int, bucket int, values binary"
TOTALS, HEADS = -1, -2


def _bucket_edges(names: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket, an equal range of hashes, begins in ascending names."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(names, edges), [len(names)]])


def _batch(columns: list[list], kind: str) -> pa.RecordBatch:
    fields = [c.split() for c in kind.split(", ")]
    types = {"int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _write_words(texts: DataFrame, buckets: int) -> str:
    """Folder of (task, part, ...): blocks of texts as numbers (part >= 0), and a task's distinct words with their counts, by bucket (part = -1 - bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            if not held:
                return np.zeros(0, np.uint64), np.zeros(0, np.int64)
            names, inverse = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return names, np.bincount(inverse, np.concatenate([c for _, c in held]), len(names)).astype(np.int64)

        for batch in batches:
            for a, b, data, offsets in K.blocks(batch.column(1), max_docs=1 << 30, max_bytes=BLOCK):
                found, counts = [], []
                for c, d, inner, inner_offsets in K.blocks(batch.column(1).slice(a, b - a), max_docs=1 << 30):
                    hashed, doc, _, _ = K.words(inner, inner_offsets)
                    found.append(hashed)
                    counts.append(np.bincount(doc, minlength=d - c))
                names, words, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
                ids = batch.column(0).slice(a, b - a)
                docs = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield _batch([[task], [part], [docs.tobytes()], [np.array(ids.is_valid()).astype(np.uint8).tobytes()], [np.concatenate(counts).astype(np.int32).tobytes()], [names.tobytes()], [words.astype(np.int32).tobytes()]], _BLOCKS)
                part += 1
                held.append((names, times))
                size += len(names)
                if size > 1_000_000:
                    held, size = [merged()], 0
        names, counts = merged()
        del held
        edges = _bucket_edges(names, buckets)
        for k in range(buckets):
            s = slice(edges[k], edges[k + 1])
            if edges[k + 1] > edges[k]:
                yield _batch([[task], [-1 - k], [None], [None], [counts[s].tobytes()], [names[s].tobytes()], [None]], _BLOCKS)
        K.release()

    path = storage.new_path(texts.sparkSession, "words")
    texts.mapInArrow(run, _BLOCKS).write.partitionBy("task").parquet(path)
    return path


def _folder(path: str, task: int) -> pa.dataset.Dataset | None:
    filesystem, root = pyarrow.fs.FileSystem.from_uri(path)
    folder = f"{root}/task={task}"
    if filesystem.get_file_info(folder).type != pyarrow.fs.FileType.Directory:
        return None
    return pyarrow.dataset.dataset(folder, filesystem=filesystem, format="parquet")


def _names(path: str, task: int) -> np.ndarray:
    """A task's distinct words, ascending."""
    found = _folder(path, task).to_table(columns=["part", "names"], filter=pyarrow.dataset.field("part") < 0, use_threads=False)
    parts = sorted(zip(found["part"].to_pylist(), found["names"].to_pylist()), reverse=True)
    return np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(n, np.uint64) for _, n in parts)])


def _emissions(path: str, task: int, totals: np.ndarray) -> np.ndarray:
    """Emission probabilities of a task's words, from the buckets' sums."""
    folder = _folder(path, task)
    if folder is None:
        return np.zeros((0, len(totals)), np.float32)
    found = folder.to_table(columns=["bucket", "values"], use_threads=False)
    parts = [v for _, v in sorted(zip(found["bucket"].to_pylist(), found["values"].to_pylist()))]
    return (np.frombuffer(b"".join(parts), np.float32).reshape(-1, len(totals)) / totals).astype(np.float32)


def _blocks(path: str, task: int, names: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, words of all texts as places in names, number of each text's words), a few written blocks at a time."""
    held, size = [], 0

    def joined() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        docs, known, counts, words = (np.concatenate(x) for x in zip(*held))
        return pa.array(docs, mask=known == 0), words, counts.astype(np.int64)

    scanner = _folder(path, task).scanner(columns=["docs", "known", "counts", "names", "words"], filter=pyarrow.dataset.field("part") >= 0, batch_size=1, use_threads=False, batch_readahead=0, fragment_readahead=0)
    for batch in scanner.to_batches():
        for row in batch.to_pylist():
            place = np.searchsorted(names, np.frombuffer(row["names"], np.uint64))
            held.append((np.frombuffer(row["docs"], np.int64), np.frombuffer(row["known"], np.uint8), np.frombuffer(row["counts"], np.int32), place[np.frombuffer(row["words"], np.int32)]))
            size += len(held[-1][3])
            if size >= TOGETHER:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _summed(sent: DataFrame, states: int, first: bool) -> str:
    """Folder of (task, bucket, values): what the buckets tell each task of its words, with a small constant so that nothing becomes impossible; sums of all words (task -1), and of the heads (task -2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[tuple[int, bytes | None, bytes]]] = {}
        for batch in batches:
            for bucket, task, names, values in zip(*(c.to_pylist() for c in batch.columns)):
                rows.setdefault(bucket, []).append((task, names, values))
        for bucket in list(rows):
            given = rows.pop(bucket)
            if bucket < 0:
                yield _batch([[HEADS], [bucket], [sum(np.frombuffer(v, np.float64) for _, _, v in given).tobytes()]], _BACK)
                continue
            words = [np.frombuffer(n, np.uint64) for _, n, _ in given]
            names = np.unique(np.concatenate(words))
            total = np.zeros((len(names), 1 if first else states))
            places = [np.searchsorted(names, w) for w in words]
            for at, (_, _, values) in zip(places, given):  # a task's words are distinct
                total[at] += np.frombuffer(values, np.int64 if first else np.float32).reshape(len(at), -1)
            total = (total * Model.noise(names, states) if first else total) + FLOOR
            yield _batch([[TOTALS], [bucket], [total.sum(0).tobytes()]], _BACK)
            total = total.astype(np.float32)
            for at, (task, _, _) in zip(places, given):
                yield _batch([[task], [bucket], [total[at].tobytes()]], _BACK)
        K.release()

    spark = sent.sparkSession
    path = storage.new_path(spark, "emissions")
    parts = storage.partitions(spark)
    with storage.shuffles_freed(spark):
        sent.repartition(parts, "bucket").mapInArrow(run, _BACK).repartition(parts, "task").write.partitionBy("task").parquet(path)
    return path


def _sums(spark: SparkSession, path: str, task: int, size: int) -> np.ndarray:
    """Totals or heads, added up: as many short rows as there are buckets."""
    found = spark.read.schema(_BACK).parquet(path).where(F.col("task") == task).select("values").toArrow()["values"].to_pylist()
    return sum((np.frombuffer(v, np.float64) for v in found), np.zeros(size))


class Trained:
    """A model whose emissions are in a written table, and the written words it belongs to."""

    def __init__(self, words: str, tasks: int, emissions: str, start: np.ndarray, move: np.ndarray, totals: np.ndarray):
        self.words, self.tasks, self.emissions, self.start, self.move, self.totals = words, tasks, emissions, start, move, totals

    def of_task(self, task: int) -> tuple[np.ndarray, Model]:
        return _names(self.words, task), Model(self.start, self.move, _emissions(self.emissions, task, self.totals))


def train(texts: DataFrame, states: int = STATES, iterations: int | None = None, tolerance: float = TOLERANCE) -> tuple[Trained | None, list[float]]:
    """(model, log-likelihood of the corpus before each iteration) of (doc_id, lower-cased text); iterations: stop after so many, converged or not. None without a row."""
    spark = texts.sparkSession
    buckets = storage.partitions(spark)
    words = _write_words(texts, buckets)
    written = spark.read.schema(_BLOCKS).parquet(words)
    tasks = written.agg(F.max("task")).first()[0]
    if tasks is None:
        return None, []
    counted = written.where("part < 0").select((-1 - F.col("part")).alias("bucket"), "task", "names", F.col("counts").alias("values"))
    emissions = _summed(counted, states, True)
    model = Trained(words, tasks + 1, emissions, *Model.first(states), _sums(spark, emissions, TOTALS, states))
    history: list[float] = []
    gains: list[float] = []
    while iterations is None or len(history) < iterations:
        given = spark.sparkContext.broadcast(model)  # small: the tables are named in it

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for task in batch.column(0).to_pylist():
                    if _folder(given.value.words, task) is None:
                        continue
                    names, model = given.value.of_task(task)
                    start, move, emit, total = np.zeros(states), np.zeros((states, states)), np.zeros((len(names), states), np.float32), 0.0
                    for _, ids, counts in _blocks(given.value.words, task, names):
                        if len(ids):
                            packed, active, _ = _packed(ids, counts)
                            found = expected(model, packed, active)
                            start, move, total = start + found[0], move + found[1], total + found[3]
                            emit += found[2]
                    yield _batch([[-1 - task % 64], [task], [None], [np.concatenate([start, move.ravel(), [total]]).tobytes()]], _SENT)
                    edges = _bucket_edges(names, buckets)
                    for k in np.flatnonzero(np.diff(edges)):
                        s = slice(edges[k], edges[k + 1])
                        yield _batch([[int(k)], [task], [names[s].tobytes()], [emit[s].tobytes()]], _SENT)
                    del names, model, emit
                    K.release()

        after = _summed(spark.range(0, model.tasks, 1, model.tasks).mapInArrow(run, _SENT), states, False)
        head = _sums(spark, after, HEADS, states + states * states + 1)
        history.append(float(head[-1]))
        start, move = head[:states] + FLOOR, head[states:-1].reshape(states, states) + FLOOR
        storage.drop(spark, model.emissions)
        model = Trained(words, model.tasks, after, start / start.sum(), move / move.sum(1, keepdims=True), _sums(spark, after, TOTALS, states))
        given.unpersist()
        if len(history) > 1:
            gains.append((history[-1] - history[-2]) / max(abs(history[-2]), 1e-300))
            if gains[-1] < tolerance and gains[-1] <= min(gains[-2:]):
                break
        elif history[0] == 0:  # no words
            break
    logging.getLogger(__name__).info("%d rounds, log-likelihoods %s", len(history), history)
    return model, history


def score(docs: DataFrame, states: int = STATES, iterations: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, n_words, log_likelihood, perplexity) for every row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    model, _ = train(texts, states, iterations, tolerance)
    kind = "doc_id long, n_words long, log_likelihood double, perplexity double"
    if model is None:
        return spark.createDataFrame([], kind)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                if _folder(sent.value.words, task) is None:
                    continue
                names, model = sent.value.of_task(task)
                for ids, words, counts in _blocks(sent.value.words, task, names):
                    packed, active, order = _packed(words, counts)
                    logs = np.zeros(len(counts))
                    if len(order):
                        _, scale, _ = forward(model, packed, active)
                        row = np.arange(len(packed)) - np.repeat(np.cumsum(active) - active, active)
                        logs[order] = np.bincount(row, np.log(scale), len(order))
                    with np.errstate(over="ignore"):
                        perplexity = np.exp(-logs / np.maximum(counts, 1))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(logs), pa.array(perplexity, mask=counts == 0)], ["doc_id", "n_words", "log_likelihood", "perplexity"])
                del names, model
                K.release()

    return spark.range(0, model.tasks, 1, model.tasks).mapInArrow(run, kind)
