"""Operator 1, benchmark decontamination: a distributed positional inverted index.

Training texts are indexed in *segments*: a segment is a run of texts of one
task, with a sorted term dictionary, the ascending word positions of each term
and the positions where texts begin.  The segments are written as a table, so
the index is built once, without a shuffle, and serves any number of lookups.

A lookup sends the test items to the segments, in slices of at most
``slice_words`` words, however long the benchmark is.  Corpus counts of the
slice's terms come from all segments first.  Then, in each segment:

* exact phrase: every window of ``n`` words of an item (all its words if it has
  fewer) is found by intersecting offset-adjusted position lists, beginning with
  the window's rarest term and stopping at the first empty list;
* proximity: around each occurrence of an *anchor*, within as many words to each
  side as the item is long and inside the text, the item's distinct terms are
  counted; the item is near if at least ``share`` of them are there.  Anchors are
  the item's rarest terms, one more than the terms that may be absent, so that
  every stretch with enough terms holds one.

Result: (doc_id, item_id, phrases, first_word, near_terms): how many of the
item's windows occur, the least word position of one in the text (null if none),
and the most terms counted around an anchor (0 if fewer than the share).

Defined cases: null or word-less texts and items, and null ids, match nothing; a
repeated row counts once in the result, texts or items that share an id are
merged by maxima (first_word by minimum); terms of equal counts are ranked by
their spelling; a very long text is one segment, a very long item one slice; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from re import compile as pattern_of

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from . import textkernel as K

N, SHARE = 13, 0.8
SEGMENT_BYTES = 8_000_000
SLICE_WORDS = 2_000_000
_WORD = pattern_of("[a-z0-9_\u0080-\U0010ffff]+")
_INDEX = "terms binary, starts binary, low binary, high binary, top binary, doc_ids binary, doc_starts binary"
_NAMES = [c.split()[0] for c in _INDEX.split(", ")]


def _segment(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """parts: (word hashes, words of each text, ids). Positions are stored as differences, in planes of bytes."""
    hashed, counts, ids = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(hashed, kind="stable")
    term = hashed[order]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    gap = np.diff(order, prepend=0)
    gap[first] = order[first]
    gap = gap.astype(np.uint32)
    plane = lambda shift, kind: ((gap >> np.uint32(shift)).astype(kind)).tobytes()
    values = [term[first].tobytes(), np.append(first, len(term)).astype(np.uint32).tobytes(), plane(0, np.uint8), plane(8, np.uint8), plane(16, np.uint16), ids.astype(np.int64).tobytes(), np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], _NAMES)


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The written table of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in K.blocks(batch.column(1), max_docs=1 << 30):
                hashed, doc, _, _ = K.words(data, offsets)
                parts.append((hashed, np.bincount(doc, minlength=b - a), ids[a:b]))
                held += len(data)
                if held >= segment_bytes:
                    yield _segment(parts)
                    parts, held = [], 0
        if parts:
            yield _segment(parts)

    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.lower("text").alias("text"))
    return storage.written(texts.mapInArrow(run, _INDEX), "postings")


class Segment:
    """Postings of one segment, read lazily by term."""

    def __init__(self, row: dict[str, bytes]):
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.starts = np.frombuffer(row["starts"], np.uint32)
        self.planes = [np.frombuffer(row[c], t) for c, t in (("low", np.uint8), ("high", np.uint8), ("top", np.uint16))]
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.doc_starts = np.frombuffer(row["doc_starts"], np.uint32).astype(np.int64)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term in the dictionary, -1 where it has none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def positions(self, place: int) -> np.ndarray:
        part = slice(int(self.starts[place]), int(self.starts[place + 1]))
        low, high, top = (p[part].astype(np.int64) for p in self.planes)
        return np.cumsum(low | high << 8 | top << 16)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_starts, position, "right") - 1


def _holds(positions: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(positions, wanted), len(positions) - 1)
    return positions[at] == wanted


def phrase(lists: list[np.ndarray], rarity: np.ndarray, segment: Segment) -> np.ndarray:
    """Positions where the lists' terms stand one after another inside one text; rarest lists are intersected first."""
    order = np.argsort(rarity, kind="stable")
    at = lists[order[0]] - order[0]
    at = at[at >= 0]
    for k in order[1:]:
        if not len(at):
            return at
        at = at[_holds(lists[k], at + k)]
    return at[segment.doc_of(at) == segment.doc_of(at + len(lists) - 1)] if len(at) else at


def near(anchors: list[np.ndarray], lists: list[np.ndarray], reach: int, segment: Segment) -> tuple[np.ndarray, np.ndarray]:
    """(text number, distinct terms around) of each anchor position."""
    p = np.concatenate(anchors)
    doc = segment.doc_of(p)
    low, high = np.maximum(p - reach, segment.doc_starts[doc]), np.minimum(p + reach, segment.doc_starts[doc + 1] - 1)
    count = np.zeros(len(p), np.int64)
    for positions in lists:
        at = np.searchsorted(positions, low)
        count += positions[np.minimum(at, len(positions) - 1)] * (at < len(positions)) + (at >= len(positions)) * (high + 1) <= high
    return doc, count


class _Slice:
    """Test items as term numbers; terms: distinct hashes, counts: their corpus counts."""

    def __init__(self, items: list[tuple[int, str]]):
        text = [t.lower() for _, t in items]
        data, offsets = K.string_buffers(pa.array(text, pa.string()))
        hashed, doc, _, _ = K.words(data, offsets)
        spelled = [w for t in text for w in _WORD.findall(t)]
        self.terms, where = np.unique(hashed, return_index=True)
        self.spelling = [spelled[i] for i in where]
        self.numbers = np.searchsorted(self.terms, hashed)
        bounds = np.searchsorted(doc, np.arange(len(items) + 1))
        self.items = [(items[i][0], self.numbers[bounds[i] : bounds[i + 1]]) for i in range(len(items))]
        self.counts = np.zeros(len(self.terms), np.int64)


def _counts(index: DataFrame, terms) -> dict[int, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms.value), np.int64)
        for batch in batches:
            for t, s in zip(batch.column(0), batch.column(1)):
                segment = np.frombuffer(t.as_py(), np.uint64)
                starts = np.frombuffer(s.as_py(), np.uint32)
                if len(segment):
                    at = np.minimum(np.searchsorted(segment, terms.value), len(segment) - 1)
                    total += np.where(segment[at] == terms.value, starts[at + 1].astype(np.int64) - starts[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    rows = index.select("terms", "starts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows["term"].to_pylist(), rows["n"].to_pylist()))


def _match(test, n: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: _Slice = test.value
        rank = np.empty(len(given.terms), np.int64)
        rank[sorted(range(len(given.terms)), key=lambda t: (given.counts[t], given.spelling[t]))] = np.arange(len(given.terms))
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row)
                place, known = segment.find(given.terms), {}
                found: dict[tuple[int, int], list] = {}

                def postings(t: int) -> np.ndarray:
                    if t not in known:
                        known[t] = segment.positions(place[t])
                    return known[t]

                for item, numbers in given.items:
                    if not len(numbers):
                        continue
                    here = place[numbers] >= 0
                    width = min(n, len(numbers))
                    inside = np.convolve(here, np.ones(width, int), "valid") == width
                    for start in np.flatnonzero(inside):
                        window = numbers[start : start + width]
                        at = phrase([postings(t) for t in window], rank[window], segment)
                        doc = segment.doc_of(at)
                        for d in np.unique(doc):
                            entry = found.setdefault((int(segment.doc_ids[d]), item), [0, None, 0])
                            entry[0] += 1
                            word = int(at[doc == d][0] - segment.doc_starts[d])
                            entry[1] = word if entry[1] is None else min(entry[1], word)
                    terms = np.unique(numbers)
                    least = int(np.ceil(share * len(terms) - 1e-9))
                    if (place[terms] >= 0).sum() < least:
                        continue
                    occurring = terms[given.counts[terms] > 0]
                    rare = [t for t in occurring[np.argsort(rank[occurring])][: len(occurring) - least + 1] if place[t] >= 0]
                    if not rare:
                        continue
                    doc, count = near([postings(t) for t in rare], [postings(t) for t in terms if place[t] >= 0], len(numbers), segment)
                    for d in np.unique(doc[count >= least]):
                        entry = found.setdefault((int(segment.doc_ids[d]), item), [0, None, 0])
                        entry[2] = max(entry[2], int(count[doc == d].max()))
                if found:
                    docs, items = zip(*found)
                    columns = zip(*found.values())
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "item_id", "phrases", "first_word", "near_terms"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, share: float = SHARE, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(doc_id, item_id, phrases, first_word, near_terms); see the module's text."""
    spark = docs.sparkSession
    index = build_index(docs)
    out = None
    held: list[tuple[int, str]] = []
    size = 0

    def look_up() -> DataFrame:
        given = _Slice(held)
        for term, count in _counts(index, spark.sparkContext.broadcast(given.terms)).items():
            given.counts[term] = count
        return index.mapInArrow(_match(spark.sparkContext.broadcast(given), n, share), "doc_id long, item_id long, phrases long, first_word long, near_terms long")

    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text")).distinct()
    for row in items.toLocalIterator():
        held.append((row.item_id, row.text))
        size += row.text.count(" ") + 1
        if size >= slice_words:
            out = look_up() if out is None else out.unionByName(look_up())
            held, size = [], 0
    if held or out is None:
        out = look_up() if out is None else out.unionByName(look_up())
    return out.groupBy("doc_id", "item_id").agg(F.max("phrases").alias("phrases"), F.min("first_word").alias("first_word"), F.max("near_terms").alias("near_terms"))


def clean(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """Documents that hold no exact phrase of an item and are near none; rows with null ids or texts stay."""
    return docs.join(contamination(docs, benchmark, **parameters).select("doc_id").distinct(), "doc_id", "left_anti")


def oracle_sql(n: int = N, share: float = SHARE) -> str:
    words = "regexp_extract_all(lower(text), '[a-z0-9_\\\\x{80}-\\\\x{10FFFF}]+')".replace("\\\\", "\\")
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    windows = f"CASE WHEN len(w) < {n} THEN [] ELSE [{{'at': i - 1, 'g': {gram}}} FOR i IN range(1, len(w) - {n - 2})] END"
    return f"""WITH items AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL), texts AS (SELECT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
long_windows AS (SELECT item_id, unnest({windows}) AS u FROM items), doc_windows AS (SELECT doc_id, unnest({windows}) AS u FROM texts),
tokens AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM texts),
counts AS (SELECT term, count(*) AS n FROM tokens GROUP BY term),
short_items AS (SELECT item_id, w, len(w) AS m FROM items WHERE len(w) BETWEEN 1 AND {n - 1}),
hits AS (SELECT doc_id, item_id, i.u.at AS item_at, d.u.at AS pos FROM long_windows i JOIN doc_windows d ON i.u.g = d.u.g
 UNION ALL SELECT t.doc_id, s.item_id, 0, t.pos FROM short_items s JOIN tokens t ON t.term = s.w[1] JOIN texts x ON x.doc_id = t.doc_id WHERE list_slice(x.w, t.pos + 1, t.pos + s.m) = s.w),
exact AS (SELECT doc_id, item_id, count(DISTINCT item_at) AS phrases, min(pos) AS first_word FROM hits GROUP BY doc_id, item_id),
terms AS (SELECT DISTINCT item_id, len(w) AS m, len(list_distinct(w)) AS k, unnest(w) AS term FROM items),
anchors AS (SELECT item_id, m, k, term FROM (SELECT t.*, row_number() OVER (PARTITION BY item_id ORDER BY n, term) AS r, count(*) OVER (PARTITION BY item_id) AS held FROM terms t JOIN counts USING (term)) WHERE r <= held - ceil({share} * k - 1e-9) + 1),
around AS (SELECT a.item_id, a.k, p.doc_id, p.pos, count(DISTINCT q.term) AS c FROM anchors a JOIN tokens p ON p.term = a.term JOIN terms t ON t.item_id = a.item_id JOIN tokens q ON q.doc_id = p.doc_id AND q.term = t.term AND q.pos BETWEEN p.pos - a.m AND p.pos + a.m GROUP BY a.item_id, a.k, p.doc_id, p.pos, a.term),
near AS (SELECT doc_id, item_id, max(c) AS near_terms FROM around WHERE c >= ceil({share} * k - 1e-9) GROUP BY doc_id, item_id)
SELECT coalesce(e.doc_id, v.doc_id) AS doc_id, coalesce(e.item_id, v.item_id) AS item_id, coalesce(phrases, 0) AS phrases, first_word, coalesce(near_terms, 0) AS near_terms FROM exact e FULL JOIN near v ON e.doc_id = v.doc_id AND e.item_id = v.item_id"""
