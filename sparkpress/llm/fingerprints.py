"""Operator 7, document fingerprints: one-permutation MinHash in packed b-bit form.

Each text's distinct word n-grams are hashed once; the top bits of a hash choose
one of ``bins`` bins and the smallest of the rest is the bin's value.  An empty
bin takes the value of another that optimal densification picks: a sequence of
2-universal hashes of (bin, attempt), the same for every text, up to the first
bin that isn't empty (Shrivastava 2017).  The lowest ``bits`` bits of each value
are packed into longs, and :func:`estimate` corrects for chance agreement of
b-bit values (Li and Koenig 2010).

Defined cases: a null, empty or word-less text has no n-grams, ``n_grams`` 0 and
a null fingerprint; a text shorter than n words has one gram, all its words; rows
are kept as they are, repeated or with null ids; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

BINS, BITS, N = 128, 4, 3


def _donors(bins: int, attempts: int) -> np.ndarray:
    """Row a: the bin that bin i asks in attempt a."""
    i = np.arange(bins, dtype=np.uint64)
    return np.stack([K.mix(i * np.uint64(0x9E3779B97F4A7C15) + np.uint64(a * 0x632BE59BD9B4E019 % 2**64)) % np.uint64(bins) for a in range(1, attempts + 1)]).astype(np.int64)


def sketch(gram: np.ndarray, offsets: np.ndarray, bins: int = BINS) -> np.ndarray:
    """(texts, bins) of bin values after densification, for texts that each have a gram."""
    texts = len(offsets) - 1
    shift = np.uint64(K.GRAM_BITS - (bins - 1).bit_length())
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    cell = owner * bins + (gram >> shift).astype(np.int64)
    first = np.concatenate([[True], cell[1:] != cell[:-1]])  # grams ascend within a text, so the first of a bin is its least
    value = np.zeros(texts * bins, np.uint64)
    full = np.zeros(texts * bins, bool)
    value[cell[first]] = gram[first] & ((np.uint64(1) << shift) - np.uint64(1))
    full[cell[first]] = True
    value, full = value.reshape(texts, bins), full.reshape(texts, bins)
    source, todo, attempt = value.copy(), ~full, 0
    while todo.any():
        for donor in _donors(bins, attempt + 64)[attempt:]:
            row, column = np.nonzero(todo)
            got = full[row, donor[column]]
            value[row[got], column[got]] = source[row[got], donor[column[got]]]
            todo[row[got], column[got]] = False
            if not len(row):
                break
        attempt += 64
    return value


def pack(value: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Lowest bits of each value, 64 / bits of them in a long."""
    lanes = 64 // bits
    low = (value & np.uint64((1 << bits) - 1)).reshape(len(value), -1, lanes)
    return np.bitwise_or.reduce(low << (np.arange(lanes, dtype=np.uint64) * np.uint64(bits)), axis=2).view(np.int64)


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, n: int = N) -> DataFrame:
    """(doc_id, n_grams, fingerprint array of bins * bits / 64 longs)."""
    if bins & (bins - 1) or 64 % bits or bins * bits % 64:
        raise ValueError("bins must be a power of two, bits a divisor of 64, and their product a multiple of 64")
    width = bins * bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for a, b, data, offsets in K.blocks(column):
                hashed, doc, _, _ = K.words(data, offsets)
                gram, off = K.grams(hashed, doc, b - a, n)
                count = np.diff(off)
                some = count > 0
                longs = np.zeros((b - a, width), np.int64)
                if some.any():
                    longs[some] = pack(sketch(gram, np.concatenate([[0], np.cumsum(count[some])]), bins), bits)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * width, width), pa.int32()), pa.array(longs.ravel()), mask=pa.array(~some))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(count, pa.int64()), lists], ["doc_id", "n_grams", "fingerprint"])

    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(run, "doc_id long, n_grams long, fingerprint array<long>")


def estimate(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two fingerprints; null when either is null."""
    lanes = 64 // bits
    ones = sum(1 << (k * bits) for k in range(lanes))

    def differing(x: Column) -> Column:
        folded = x
        for k in range(1, bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(folded.bitwiseAND(F.lit(ones if ones < 2**63 else ones - 2**64)))

    different = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-bits
    return F.greatest(F.lit(0.0), ((1 - different / bins) - chance) / (1 - chance))
