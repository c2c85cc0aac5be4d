"""Operator 4, token counts: exact byte-level BPE counts, with huge documents encoded in overlapping chunks.

A text of at most ``chunk_chars`` characters is encoded whole, in the scan.  A
longer one is cut into chunks that start every ``chunk_chars`` characters and
reach ``overlap`` characters into the next, which are spread over the cluster.
Each chunk is encoded on its own; token lengths give the byte offset of every
token boundary.  Neighbours are spliced at the first boundary in their overlap
that both have and that is *proven stable*: the byte before it isn't white space
and the byte at it is.  No match of the vocabulary's pre-tokeniser pattern spans
such a place (white space is only matched first in a match that otherwise has
none, or in a run of white space), and the pattern never looks back, so from
there on both encodings are that of the whole text.

If an overlap has no such boundary, alignment has failed: that document alone is
encoded again with overlaps four times as wide (and longer chunks where these
wouldn't exceed the overlap), until all align or one chunk holds the whole text.

Result: (doc_id, n_tokens, n_chunks): one row for each row of documents.

Defined cases: a null text has null tokens and 0 chunks; an empty one 0 tokens
in 1 chunk; rows are kept as they are, repeated or with null ids; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = "|".join(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", r" ?\p{L}+", r" ?\p{N}+", r" ?[^\s\p{L}\p{N}]+", r"\s+(?!\S)", r"\s+"])
CHUNK_CHARS, OVERLAP = 16_384, 256
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """(encoding, bytes of each token) of a tiktoken vocabulary file."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file)}
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        length[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), length


def stable(data: np.ndarray) -> np.ndarray:
    """Byte offsets inside data that no pre-token can span, whatever surrounds data."""
    space = _SPACE[data]
    return np.flatnonzero(~space[:-1] & (data[:-1] < 128) & space[1:]) + 1


def encoded(first: int, text: str, head: int, tail: int, path: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, offsets and token numbers of stable boundaries in the first ``head`` and the last ``tail`` bytes) of a chunk whose first byte is at ``first``."""
    encoding, length = encoder(path)
    data = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(length[np.array(encoding.encode_ordinary(text), np.int64)])
    at = stable(data) if len(data) else np.zeros(0, np.int64)
    number = np.searchsorted(ends, at)
    good = (number < len(ends)) & (ends[np.minimum(number, max(len(ends) - 1, 0))] == at) if len(ends) else np.zeros(len(at), bool)
    at, number = at[good], number[good] + 1
    left, right = at < head, at >= len(data) - tail
    return len(ends), first + at[left], number[left], first + at[right], number[right]


def fold(chunks: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> int | None:
    """Tokens of the text whose encoded chunks, in order, overlap; None if two neighbours share no stable boundary."""
    total = begin = 0
    for here, after in zip(chunks, chunks[1:]):
        common, i, j = np.intersect1d(here[3], after[1], return_indices=True)
        if not len(common):
            return None
        total += int(here[4][i[0]]) - begin
        begin = int(after[2][j[0]])
    return total + chunks[-1][0] - begin


def cut(text: str, chunk_chars: int, overlap: int) -> list[tuple[int, str, int, int]]:
    """(first byte, text, bytes shared with the chunk before, with the one after) of each chunk."""
    starts = list(range(0, max(1, len(text) - overlap), chunk_chars))
    parts, first = [], 0
    for k, s in enumerate(starts):
        shared = [len(text[t : t + overlap].encode()) for t in (s, s + chunk_chars)]
        last = k == len(starts) - 1
        parts.append((first, text[s:] if last else text[s : s + chunk_chars + overlap], shared[0] if k else 0, 0 if last else shared[1]))
        first += len(text[s : s + chunk_chars].encode())
    return parts


def count_widening(text: str, path: str, chunk_chars: int, overlap: int) -> tuple[int, int]:
    """(tokens, chunks) of one text, with overlaps four times as wide after each failure to align."""
    while True:
        if overlap >= chunk_chars:
            chunk_chars = overlap * 4
        parts = cut(text, chunk_chars, overlap)
        found = fold([encoded(*p, path) for p in parts])
        if found is not None:
            return found, len(parts)
        overlap *= 4


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, n_chunks) for every row of docs."""
    if not 0 < overlap < chunk_chars:
        raise ValueError("overlap must be positive and less than a chunk")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    huge = F.length("text") > chunk_chars + overlap
    schema = "doc_id long, n_tokens long, n_chunks long"
    names = ["doc_id", "n_tokens", "n_chunks"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _ = encoder(vocabulary)
        for batch in batches:
            count = [None if t is None else len(encoding.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array([int(c is not None) for c in count], pa.int64())], names)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for doc, text, digest in zip(*(c.to_pylist() for c in batch.columns)):
                parts = cut(text, chunk_chars, overlap)
                row += 1
                # a few chunks at a time: a text of any length is passed on in small batches
                for s in range(0, len(parts), 64):
                    part = parts[s : s + 64]
                    same = lambda v, t: pa.array([v] * len(part), t)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(task, pa.int64()), same(row, pa.int64()), same(doc, pa.int64()), same(digest, pa.int64()), pa.array(range(s, s + len(part)), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*part), (pa.int64(), pa.string(), pa.int64(), pa.int64())))], ["task", "row", "doc_id", "digest", "chunk", "first", "text", "head", "tail"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encoded(f, t, h, e, vocabulary) for f, t, h, e in zip(*(batch.column(c).to_pylist() for c in ("first", "text", "head", "tail")))]
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(columns[0], pa.int64()), *(pa.array(list(c), pa.list_(pa.int64())) for c in columns[1:])], ["task", "row", "doc_id", "digest", "chunk", "n", "head_at", "head_n", "tail_at", "tail_n"])

    def spliced(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk").to_pydict()
        total = fold([(n, *(np.array(v, np.int64) for v in lists)) for n, *lists in zip(*(rows[c] for c in ("n", "head_at", "head_n", "tail_at", "tail_n")))])
        return pa.table({"doc_id": pa.array(rows["doc_id"][:1], pa.int64()), "n_tokens": pa.array([total], pa.int64()), "n_chunks": pa.array([len(rows["n"])], pa.int64()), "digest": pa.array(rows["digest"][:1], pa.int64())})

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [count_widening(t, vocabulary, chunk_chars, overlap * 4) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), ())))], names)

    long = base.where(huge).withColumn("digest", F.xxhash64("text"))
    chunks = long.mapInArrow(chunked, "task long, row long, doc_id long, digest long, chunk long, first long, text string, head long, tail long")
    chunks = chunks.repartition(storage.partitions(docs.sparkSession), "task", "row", "chunk")
    lists = ", ".join(f"{c} array<long>" for c in ("head_at", "head_n", "tail_at", "tail_n"))
    parts = chunks.mapInArrow(encode, f"task long, row long, doc_id long, digest long, chunk long, n long, {lists}")
    folded = storage.written(parts.groupBy("task", "row").applyInArrow(spliced, schema + ", digest long"), "spliced")
    failed = folded.where("n_tokens IS NULL").select(F.col("doc_id").alias("failed_id"), "digest").distinct()
    again = long.join(failed, long["doc_id"].eqNullSafe(failed["failed_id"]) & (long["digest"] == failed["digest"]), "left_semi").select("doc_id", "text")
    return base.where(~huge | F.col("text").isNull()).mapInArrow(whole, schema).unionByName(folded.where("n_tokens IS NOT NULL").select(*names)).unionByName(again.mapInArrow(widened, schema))
