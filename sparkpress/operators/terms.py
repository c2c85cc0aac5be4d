"""Term statistics over units: one pass of a kernel over texts for what concerns a text alone, counts of the whole table by word.

A word's count reaches the kernels by the hash of the word; words that occur once are not sent.  Units of one key
are one unit: their texts are put together before, which is rare and so looked for in the keys alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import lexicon, shared
from ..functions import text as T

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123), 95]] = True
BLOCK_BYTES = 4_000_000


def blocks(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """(first row, row after the last, row of each word, its number, the words by number) of bounded runs of a batch's texts; words are runs of [a-z0-9_] in lower case."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(size), 0
    while first < len(size):
        before = ends[first] - size[first]
        last = max(first + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, "right")))
        texts = pc.utf8_lower(batch.column(column).slice(first, last - first).cast(pa.large_string()).fill_null(""))
        _, offsets, raw = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        inside = _INSIDE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[offsets] = True
        start = np.flatnonzero(edge)
        keep = np.flatnonzero(inside[start[:-1]])
        pieces = pa.LargeStringArray.from_buffers(len(start) - 1, pa.py_buffer(start.astype(np.int64)), raw) if len(start) > 1 else pa.array([], pa.large_string())
        words = pieces.take(pa.array(keep)).dictionary_encode()
        yield first, last, np.searchsorted(offsets, start[:-1][keep], "right") - 1, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
        first = last


def content(names: pa.Array) -> np.ndarray:
    """Which words are terms: two characters or more, no stopword, no digit first."""
    long = pc.and_(pc.greater_equal(pc.binary_length(names), 2), pc.invert(pc.is_in(names, pa.array(lexicon.STOPWORDS, names.type))))
    return pc.and_(long, pc.invert(pc.match_substring_regex(names, "^[0-9]"))).to_numpy(zero_copy_only=False)


def _terms_of(row: np.ndarray, code: np.ndarray, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, times) of each text's distinct terms, by row."""
    keep = content(names)[code] if len(names) else np.zeros(0, bool)
    pair, times = np.unique(row[keep] * len(names) + code[keep], return_counts=True)
    return pair // max(1, len(names)), pair % max(1, len(names)), times


def _hashed(names: pa.Array) -> np.ndarray:
    from pandas.util import hash_array

    return hash_array(names.to_numpy(zero_copy_only=False), categorize=False) if len(names) else np.zeros(0, np.uint64)


def _counts(units: DataFrame, key: str, distinct: bool, name: str, count: str) -> DataFrame:
    """(name, count): units that hold each term, or occurrences of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, row, code, names in blocks(batch):
                if distinct:
                    code = _terms_of(row, code, names)[1]
                n = np.bincount(code, minlength=len(names))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(some)).cast(pa.string()), pa.array(n[some], pa.int64())], [name, count])

    rows = shared.spread(units.select(key, "text")).mapInArrow(run, f"{name} string, {count} long")
    return rows.groupBy(name).agg(F.sum(count).alias(count))


def sent(counts: DataFrame, name: str, count: str) -> Broadcast:
    """(hashes, counts) of the words that occur more than once, for ``looked_up``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hashed(batch.column(0)).view(np.int64)), batch.column(1)], ["h", "n"])

    found = counts.where(F.col(count) > 1).select(name, count).mapInArrow(run, "h long, n long").toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return counts.sparkSession.sparkContext.broadcast((h[order], n[order]))


def looked_up(counts: tuple[np.ndarray, np.ndarray], names: pa.Array) -> np.ndarray:
    h, n = counts
    own = _hashed(names)
    at = np.minimum(np.searchsorted(h, own), max(0, len(h) - 1))
    return np.where(h[at] == own, n[at], 1) if len(h) else np.ones(len(own), np.int64)


def bigram_digests(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, digest): number and md5 of each row's neighbouring terms, joined by _ and |; null for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, code, names in blocks(batch):
                keep = content(names)[code] if len(names) else np.zeros(0, bool)
                row, word = row[keep], np.array(names.to_pylist(), object)[code[keep]]
                ends = np.searchsorted(row, np.arange(b - a), "right").tolist()
                n, digest, first = [], [], 0
                for last in ends:
                    terms = word[first:last].tolist()
                    n.append(max(0, len(terms) - 1))
                    digest.append(hashlib.md5("|".join(map("_".join, zip(terms, terms[1:]))).encode()).hexdigest())
                    first = last
                null = batch.column(1).slice(a, b - a).is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64(), mask=null), pa.array(digest, pa.string(), mask=null)], [key, "n", "digest"])

    return shared.spread(units.select(key, "text")).mapInArrow(run, StructType([units.schema[key], *StructType.fromDDL("n long, digest string")]))


def repeated(units: DataFrame, key: str) -> DataFrame | None:
    """(key) of keys that several units have; none if no key has."""
    many = shared.written(units.groupBy(key).count().where("count > 1").select(key), "repeated")
    return None if many.isEmpty() else many


def whole(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text, tokens) with one row a key: texts of one key are put together, and so are their tokens."""
    units = units.select(key, "text")
    tokens = T.token_count(F.col("text")).alias("tokens")
    many = repeated(units, key)
    if many is None:
        return units.select("*", tokens)
    many = many.withColumnRenamed(key, "again")
    same = units[key].eqNullSafe(many["again"])
    joined = units.join(many, same, "left_semi").select("*", tokens).groupBy(key).agg(F.array_join(F.collect_list("text"), "\n").alias("text"), F.sum("tokens").alias("tokens"))
    return units.join(many, same, "left_anti").select("*", tokens).unionByName(joined)


def document_frequency(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, df)."""
    return _counts(whole(units, key), key, True, "term", "df")


def idf(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, df, idf): smoothed probabilistic, at least 0.05; 1.0 for a single unit. The unit count is one row, joined once."""
    n = units.agg(F.countDistinct(key).alias("n"))
    df = document_frequency(units, key).crossJoin(F.broadcast(n))
    value = F.when(F.col("n") <= 1, 1.0).otherwise(F.greatest(F.lit(0.05), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)))
    return df.select("term", "df", value.alias("idf"), "n")


def _kernel(units: DataFrame, key: str, fields: str, result) -> DataFrame:
    """Rows that ``result`` gives for a block: (rows of the block, their terms' rows, numbers, times and df, the words, number of units, tokens) to (place of the row, ...columns)."""
    units = whole(units, key)
    n = units.agg(F.countDistinct(key)).first()[0]
    counts = sent(_counts(units, key, True, "term", "df"), "term", "df")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, row, code, names in blocks(batch):
                row, code, times = _terms_of(row, code, names)
                df = looked_up(counts.value, names)
                at, *columns = result(row, code, times, df, names, n, tokens[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(at)), *columns], [key, *(f.split()[0] for f in fields.split(", "))])

    schema = StructType([units.schema[key], *StructType.fromDDL(fields)])
    return shared.spread(units.select(key, "text", "tokens")).mapInArrow(run, schema)


def _weights(row: np.ndarray, code: np.ndarray, times: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """tf x idf of unit length within each row."""
    value = np.ones(len(df)) if n <= 1 else np.maximum(0.05, np.log((n - df + 0.5) / (df + 0.5) + 1))
    w = times * value[code]
    return w / np.sqrt(np.bincount(row, w * w))[row] if len(w) else w


def vectors(units: DataFrame, key: str = "doc_id", top: int | None = None) -> DataFrame:
    """(key, term, w): tf x idf of unit length; only the ``top`` heaviest of each unit, by weights of nine places and then by term, if asked."""

    def result(row, code, times, df, names, n, tokens):
        w = _weights(row, code, times, df, n)
        if top is not None:
            place = np.empty(len(names), np.int64)
            place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
            order = np.lexsort((place[code], -np.floor(w * 1e9 + 0.5), row))
            row, code, w = row[order], code[order], w[order]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
            keep = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row))) < top
            row, code, w = row[keep], code[keep], w[keep]
        return row, names.take(pa.array(code)).cast(pa.string()), pa.array(w)

    return _kernel(units, key, "term string, w double", result)


def generic_share(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, generic): share of a unit's distinct terms that more than half of the units have."""

    def result(row, code, times, df, names, n, tokens):
        some, first = np.unique(row, return_index=True)
        return some, pa.array(np.add.reduceat((df[code] > n / 2).astype(float), first) / np.diff(first, append=len(row)) if len(some) else np.zeros(0))

    return _kernel(units, key, "generic double", result)


def information_density(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, density): sum of weights x (1 + 0.55 x relative entropy) / tokens ^ 0.35; a unit without a key has none."""

    def result(row, code, times, df, names, n, tokens):
        w = _weights(row, code, times, df, n)
        some, first = np.unique(row, return_index=True)
        if not len(some):
            return some, pa.array(np.zeros(0))
        k = np.diff(first, append=len(row))
        s = np.add.reduceat(w, first)
        p = w / np.repeat(s, k)
        h = -np.add.reduceat(p * np.log(p), first)
        relative = np.where(k > 1, h / np.log(np.maximum(k, 2)), 0.0)
        return some, pa.array(s * (1 + 0.55 * relative) / np.maximum(1, tokens[some]) ** 0.35)

    return _kernel(units, key, "density double", result).where(F.col(key).isNotNull())


def self_information(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """(word, n, information): -ln of each word's share of all words."""
    words = _counts(units, key, False, "word", "n")
    total = words.agg(F.sum("n").alias("total"))
    return words.crossJoin(F.broadcast(total)).select("word", "n", (-F.log(F.col("n") / F.col("total"))).alias("information"))


def information_of(units: DataFrame, key: str = "doc_id") -> tuple[Broadcast, int]:
    """Counts of the words of all units, for ``information``, and their sum."""
    counts = shared.written(_counts(units, key, False, "word", "n"), "words")
    return sent(counts, "word", "n"), counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def information(counts: tuple[np.ndarray, np.ndarray], total: int, names: pa.Array) -> np.ndarray:
    """-ln of each word's share of all words."""
    return -np.log(looked_up(counts, names) / max(1, total))


def dropped_tokens(units: DataFrame, share: float, key: str = "doc_id") -> DataFrame | None:
    """(key, pos, word): the words of most information, by nine places and then by place, up to a share of each text; None if several texts have one key."""
    if repeated(units, key) is not None:
        return None
    counts, total = information_of(units, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, code, names in blocks(batch):
                value = np.floor(information(counts.value, total, names) * 1e9 + 0.5)
                first = np.searchsorted(row, np.arange(b - a))
                size = np.diff(first, append=len(row))
                order = np.lexsort((-value[code], row))  # stable: by place among equals
                keep = np.sort(order[np.arange(len(row)) - first[row] + 1 <= size[row] * share])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row[keep])), pa.array(keep - first[row[keep]], pa.int64()), names.take(pa.array(code[keep])).cast(pa.string())], [key, "pos", "word"])

    return shared.spread(units.select(key, "text")).mapInArrow(run, StructType([units.schema[key], *StructType.fromDDL("pos long, word string")]))
