"""Operator 3, n-gram Jaccard join over a count-vector R-tree.

Finds every pair of texts whose sets of distinct word n-grams have Jaccard
similarity of at least ``threshold``.  Texts with the same set are one *point*;
the join runs over points.

1. **Order.**  Two bounded summaries of the whole corpus, word counts and gram
   counts in hashed cells, give every gram a rank: likely grams last.  Any order
   gives the same result; this one keeps common phrases out of the prefixes.
2. **Slabs.**  A point is placed, R+-tree style, in the slab of each gram of its
   prefix, the first ``size - ceil(threshold * size) + 1`` grams of the order: two
   points that share no slab have too few common grams left.  Slabs move between
   tasks as packed arrays, one row for a block of texts and a bucket of slabs.
   Slabs with the same members are one slab.
3. **R-tree.**  Grams are hashed to groups, four times as many for each fourfold
   size (``GROUPS``), so that a group holds a few grams; the group counts are the
   point's coordinates.  Coordinates of a larger space fold into those of a
   smaller one, where points of different sizes meet.  In each slab points are packed by size into leaves of
   ``LEAF``, a leaf keeps its coordinate maxima and sizes, and leaf pairs, then
   point pairs, survive only if the sum of coordinate minima, which bounds the
   overlap from above, reaches ``threshold / (1 + threshold) * (size a + size b)``.
4. **Verification.**  Slabs with one least member, their *lead*, meet in one
   task; a pair that several leads find goes with the least.  Pairs are verified
   by lead, so no task depends on how far candidates chain, and their grams are
   counted exactly.  A lead with more than ``WIDE`` pairs (a group of near copies
   grows with the table) is cut into blocks of ``BLOCK`` points, and each pair of
   blocks is a task of its own, from candidates to verification.

``classes`` gives one row for each row of the table: (doc_id, class_id, links).
links is the number of other rows whose text reaches the threshold, copies and
rows of the same or no id among them; class_id is the least id of the rows that
links connect.  A row without words has no links and its own id as class.

``jaccard_pairs`` gives (doc_a, doc_b, jaccard), doc_a < doc_b, jaccard rounded
to 6 places.  A point with several ids is represented by its least id; its other
ids are listed as (least id, id, 1.0), and pairs of points are listed between
least ids.  With ``expand`` all pairs of ids are listed, quadratic in exact copies.

Defined cases: rows with a null id or text and texts without words form no
pair (but see ``classes`` for null ids); a text of one or two words has one gram,
of all its words; copies of a row are one; two texts under one id form no pair
with each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import textkernel as K
from . import stars as graph

N, THRESHOLD = 3, 0.5
#: (largest size, groups): the spaces of the points; one byte a coordinate, 255 for that or more.
GROUPS = ((256, 128), (1024, 512), (4096, 2048), (1 << 62, 8192))
LEAF = 32
#: A lead with more pairs than WIDE is dealt out over tasks, each of two blocks of about BLOCK points.
WIDE, BLOCK = 500_000, 1000
#: Cells of the two corpus summaries, and the share of texts (of words) from which a cell is listed in them.
GRAM_CELLS, WORD_CELLS = 1 << 22, 1 << 20
GRAM_SHARE, WORD_SHARE = 1e-3, 1e-6


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.lower("text").alias("text"))


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(word hashes, ids, grams, offsets) of blocks of a batch of (doc_id, text)."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for a, b, data, offsets in K.blocks(batch.column(1)):
        hashed, doc, _, _ = K.words(data, offsets)
        yield hashed, doc, ids[a:b], *K.grams(hashed, doc, b - a, n)


def _signature(gram: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One 64-bit value for each set of grams."""
    size = np.diff(off)
    out = np.zeros(len(size), np.uint64)
    some = size > 0
    if some.any():
        out[some] = K.mix(np.add.reduceat(K.mix(gram + np.uint64(1)), off[:-1][some]) + size[some].astype(np.uint64))
    return out


def _summaries(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(common gram cells, ascending; -log probability of each word cell): bounded however large the corpus is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_count, gram_count = np.zeros(WORD_CELLS, np.int64), np.zeros(GRAM_CELLS, np.int64)
        seen: set[int] = set()
        held: list[np.ndarray] = []
        docs = pending = 0
        for batch in batches:
            for hashed, _, ids, gram, off in _sets(batch, n):
                word_count += np.bincount((hashed & np.uint64(WORD_CELLS - 1)).astype(np.int64), minlength=WORD_CELLS)
                sig = _signature(gram, off)
                fresh = np.array([s not in seen and not seen.add(s) for s in sig.tolist()], bool)
                docs += int(fresh.sum())
                held.append((gram[np.repeat(fresh, np.diff(off))] & np.uint64(GRAM_CELLS - 1)).astype(np.int32))
                pending += len(held[-1])
                if pending > GRAM_CELLS:
                    gram_count += np.bincount(np.concatenate(held), minlength=GRAM_CELLS)
                    held, pending = [], 0
        if held:
            gram_count += np.bincount(np.concatenate(held), minlength=GRAM_CELLS)
        total = int(word_count.sum())
        for kind, count, least in ((0, word_count, max(2, word_count.sum() * WORD_SHARE)), (1, gram_count, max(8, docs * GRAM_SHARE))):
            cell = np.flatnonzero(count >= least)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), kind, np.int32)), pa.array(cell), pa.array(count[cell])], ["kind", "cell", "n"])
        del word_count, gram_count, held, count
        K.release()
        yield pa.RecordBatch.from_arrays([pa.array([2, 3], pa.int32()), pa.array([0, 0], pa.int64()), pa.array([docs, total], pa.int64())], ["kind", "cell", "n"])

    found = texts.mapInArrow(run, "kind int, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    kind, cell, count = (np.array(found[c], np.int64) for c in ("kind", "cell", "n"))
    docs, total = int(count[kind == 2].sum()), max(1, int(count[kind == 3].sum()))
    words = np.full(WORD_CELLS, -math.log(WORD_SHARE), np.float32)
    words[cell[kind == 0]] = -np.log(np.maximum(count[kind == 0] / total, WORD_SHARE))
    return np.sort(cell[(kind == 1) & (count >= docs * GRAM_SHARE)]), words


def _keys(hashed: np.ndarray, doc: np.ndarray, docs: int, n: int, common: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of each text, rarest first: 8 bits of rank class above 46 bits of the gram's hash.

    The class depends on the gram alone, so a gram has the same key in every text.
    """
    gram, owner, at = K.raw_grams(hashed, doc, docs, n)
    surprise = words[(hashed & np.uint64(WORD_CELLS - 1)).astype(np.int64)]
    total = np.zeros(len(at), np.float32)
    for k in range(n):
        inside = np.flatnonzero(at + k < len(doc))  # a short text may end the block: its last word counts once
        j = at[inside] + k
        total[inside] += np.where(doc[j] == owner[inside], surprise[j], 0)
    rank = np.clip(254 - total * (254 / (n * -math.log(WORD_SHARE))), 0, 254).astype(np.uint64)
    gram = gram >> np.uint64(64 - K.GRAM_BITS)
    rank[common[(gram & np.uint64(GRAM_CELLS - 1)).astype(np.int64)]] = 255
    return K.distinct((rank << np.uint64(46)) | (gram & np.uint64((1 << 46) - 1)), owner, docs)


def _space(size: np.ndarray) -> np.ndarray:
    """Number of the space of points of these sizes."""
    return np.searchsorted([most for most, _ in GROUPS], size)


def _coordinates(key: np.ndarray, owner: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Group counts of each text, in the space of its size."""
    out = [b""] * len(size)
    space = _space(size)
    for c, (_, groups) in enumerate(GROUPS):
        texts = np.flatnonzero((space == c) & (size > 0))
        if len(texts):
            place = np.full(len(size), -1)
            place[texts] = np.arange(len(texts))
            mine = place[owner] >= 0
            table = np.bincount(place[owner[mine]] * groups + (key[mine] & np.uint64(groups - 1)).astype(np.int64), minlength=len(texts) * groups)
            table = np.minimum(table, 255).astype(np.uint8).reshape(len(texts), groups)
            for t, row in zip(texts.tolist(), table):
                out[t] = row.tobytes()
    return out


def _shrunk(counts: bytes) -> bytes:
    """Coordinates, nearly all of them 0 to 3, in a few bits each; a point is sent to each of its leads."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -9, 5, zlib.Z_HUFFMAN_ONLY)
    return packer.compress(counts) + packer.flush()


_MOVED = "bucket int, keys binary, sigs binary, doc_id long, text_hash long, sig long, size int, counts binary"
_KEPT = "slab long, sigs array<long>, doc_id long, text_hash long, sig long, size int, counts binary"


def _place(n: int, threshold: float, buckets: int, summaries):
    """Texts to points and, packed by bucket, to the entries of their slabs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, words = summaries.value
        common = np.zeros(GRAM_CELLS, bool)
        common[cells] = True
        seen: set[int] = set()
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(2)
            for a, b, data, offsets in K.blocks(batch.column(1)):
                hashed, doc, _, _ = K.words(data, offsets)
                key, off = _keys(hashed, doc, b - a, n, common, words)
                size, sig = np.diff(off), _signature(key, off)
                owner = np.repeat(np.arange(b - a), size)
                counts = [_shrunk(c) for c in _coordinates(key, owner, size)]
                null = pa.nulls(b - a, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array((sig % np.uint64(buckets)).astype(np.int32)), null, null, ids.slice(a, b - a), hashes.slice(a, b - a), pa.array(sig.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(counts, pa.binary())],
                    ["bucket", "keys", "sigs", "doc_id", "text_hash", "sig", "size", "counts"],
                )
                fresh = np.array([s not in seen and not seen.add(s) for s in sig.tolist()], bool)
                prefix = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
                inside = (np.arange(len(key)) - np.repeat(off[:-1], size) < prefix[owner]) & fresh[owner]
                key, member = key[inside], sig[owner[inside]]
                bucket = (((key & np.uint64((1 << 32) - 1)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                key, member, bucket = key[order], member[order], bucket[order]
                at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
                ends = np.append(at[1:], len(bucket))
                none = [pa.nulls(len(at), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array([key[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()), pa.array([member[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()), *none], ["bucket", "keys", "sigs", "doc_id", "text_hash", "sig", "size", "counts"])
        K.release()

    return run


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slabs of two points or more, each set of members once; points pass through."""
    names = ["slab", "sigs", "doc_id", "text_hash", "sig", "size", "counts"]
    keys, sigs = [], []
    for batch in batches:
        point = batch.filter(pa.compute.is_valid(batch.column(5)))
        if point.num_rows:
            yield pa.RecordBatch.from_arrays([pa.nulls(point.num_rows, pa.int64()), pa.nulls(point.num_rows, pa.list_(pa.int64())), *point.columns[3:]], names)
        for k, s in zip(batch.column(1), batch.column(2)):
            if k.is_valid:
                keys.append(np.frombuffer(k.as_py(), np.uint64))
                sigs.append(np.frombuffer(s.as_py(), np.uint64))
    if not keys:
        return
    key, sig = np.concatenate(keys), np.concatenate(sigs)
    keys, sigs = [], []
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    key, sig = key[shared], sig[order[shared]]
    order = np.lexsort((sig, key))
    key, sig = key[order], sig[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
    key, sig = key[keep], sig[keep]
    if not len(key):
        return
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(at, append=len(key))
    name = K.mix(np.add.reduceat(K.mix(sig), at) + length.astype(np.uint64))
    many = np.flatnonzero(length > 1)
    _, first = np.unique(name[many], return_index=True)
    many = many[first]
    for part in np.array_split(many, max(1, len(many) // 5000)):
        if len(part):
            member = np.concatenate([sig[at[i] : at[i] + length[i]] for i in part]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length[part])]).astype(np.int32)), pa.array(member))
            none = [pa.nulls(len(part), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(name[part].view(np.int64)), lists, *none], names)
    del key, sig, name, at, length
    K.release()


def required(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Least overlap of sets of a and b elements whose Jaccard similarity reaches the threshold."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def _pairs_of(runs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.triu_indices(length, 1)
    return (runs[:, None] + i).ravel(), (runs[:, None] + j).ravel()


class Points:
    """Sizes and coordinates of points; ``tables[c]`` has the points of space c or larger, folded into space c."""

    def __init__(self, size: np.ndarray, coordinates: list[bytes]):
        self.size, self.space = size, _space(size)
        self.tables, self.place, self.full = [], [], np.zeros(len(size), bool)
        above = None
        for c in range(len(GROUPS) - 1, -1, -1):
            groups = GROUPS[c][1]
            own = np.flatnonzero(self.space == c)
            rows = np.frombuffer(b"".join(coordinates[i] for i in own), np.uint8).reshape(len(own), groups)
            self.full[own] = (rows == 255).any(1)
            rows, where = rows.astype(np.uint16), own
            if above is not None and len(above[1]):
                rows, where = np.concatenate([rows, above[0].reshape(len(above[0]), -1, groups).sum(1, dtype=np.uint16)]), np.concatenate([own, above[1]])
            place = np.full(len(size), -1)
            place[where] = np.arange(len(where))
            self.tables.insert(0, rows)
            self.place.insert(0, place)
            above = rows, where

    def bounded(self, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose sum of coordinate minima reaches the required overlap."""
        size = self.size
        ok = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
        a, b = a[ok], b[ok]
        keep = self.full[a] | self.full[b]
        space = np.minimum(self.space[a], self.space[b])
        for c, (_, groups) in enumerate(GROUPS):
            pairs = np.flatnonzero((space == c) & ~keep)
            step = max(1, 4_000_000 // groups)
            for s in range(0, len(pairs), step):
                part = pairs[s : s + step]
                x, y = self.place[c][a[part]], self.place[c][b[part]]
                keep[part] = np.minimum(self.tables[c][x], self.tables[c][y]).sum(1, dtype=np.int64) >= required(size[a[part]], size[b[part]], threshold)
        return a[keep], b[keep]


def rtree_pairs(points: Points, members: np.ndarray, threshold: float = THRESHOLD, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members that the bound lets through: points packed by size into leaves, then a join of the tree with itself."""
    counts = points.tables[0][points.place[0][members]]
    # packed by size, then by where most of the mass lies, so that a leaf's maxima stay near its points
    order = np.lexsort((counts.argmax(1), points.size[members]))
    members, counts = members[order], counts[order].astype(np.int64)
    size = points.size[members]
    counts[points.full[members]] = 1 << 40
    starts = np.arange(0, len(size), leaf)
    ends = np.append(starts[1:], len(size))
    high = np.maximum.reduceat(counts, starts, axis=0)
    least, most = size[starts], size[ends - 1]
    out_a, out_b = [], []
    for i in range(len(starts)):
        # a later leaf has larger points only; it is out of reach once its least size exceeds this leaf's largest over the threshold
        j = np.arange(i, int(np.searchsorted(least, most[i] / threshold + 1e-9, "right")))
        j = j[np.minimum(high[i], high[j]).sum(1) >= required(least[i], least[j], threshold)]
        for k in j:
            x, y = (v.ravel() for v in np.meshgrid(np.arange(starts[i], ends[i]), np.arange(starts[k], ends[k]), indexing="ij"))
            if k == i:
                x, y = x[x < y], y[x < y]
            x, y = points.bounded(members[x], members[y], threshold)
            out_a.append(x)
            out_b.append(y)
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in (out_a, out_b))


def _runs(lead: np.ndarray, slab: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, lead of each, first, length) of runs that hold all pairs of the slabs: all points of a lead where these are fewer pairs than those of its slabs, which in a group of near copies repeat each other, else each slab."""
    order = np.lexsort((slab, lead))
    lead, slab, node = lead[order], slab[order], node[order]
    at = np.flatnonzero(np.concatenate([[True], (slab[1:] != slab[:-1]) | (lead[1:] != lead[:-1])]))
    length = np.diff(at, append=len(slab))
    leads, of = np.unique(lead, return_inverse=True)
    pairs = np.bincount(of[at], length * (length - 1.0) / 2, len(leads))
    order = np.lexsort((node, of))
    whole_of, whole = of[order], node[order]
    keep = np.concatenate([[True], (whole[1:] != whole[:-1]) | (whole_of[1:] != whole_of[:-1])])
    whole_of, whole = whole_of[keep], whole[keep]
    count = np.bincount(whole_of, minlength=len(leads))
    joined = count * (count - 1.0) / 2 <= pairs
    whole_of, whole = whole_of[joined[whole_of]], whole[joined[whole_of]]
    apart = ~joined[of]
    key = np.concatenate([whole_of, np.repeat(np.arange(len(at)), length)[apart] + len(leads)])
    node, lead = np.concatenate([whole, node[apart]]), np.concatenate([leads[whole_of], lead[apart]])
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return node, lead, at, np.diff(at, append=len(key))


def _candidates(threshold: float):
    """Memberships (lead, slab, sig) and points (lead, sig, size, counts) of whole leads to point pairs (lead, a, b), each once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("lead", pa.int64()), ("slab", pa.int64()), ("sig", pa.int64()), ("size", pa.int32()), ("counts", pa.binary())]))
        known = table.filter(pa.compute.is_valid(table["size"]))
        table = table.filter(pa.compute.is_valid(table["slab"]))
        if not table.num_rows:
            return
        # a point comes once for each lead of this task
        names, where = np.unique(known["sig"].to_numpy(), return_index=True)
        known = known.take(pa.array(where))
        points = Points(known["size"].to_numpy().astype(np.int64), [zlib.decompress(c, -15) for c in known["counts"].to_pylist()])
        node, lead, at, length = _runs(table["lead"].to_numpy(), table["slab"].to_numpy(), np.searchsorted(names, table["sig"].to_numpy()))
        del table, known
        leads, lead = np.unique(lead, return_inverse=True)
        found, of, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def once() -> None:
            nonlocal found, of, held
            pair, by = np.concatenate(found), np.concatenate(of)
            order = np.lexsort((by, pair))
            pair, by = pair[order], by[order]
            keep = np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)]
            found, of, held = [pair[keep]], [by[keep]], 0

        def add(x: np.ndarray, y: np.ndarray, by: np.ndarray) -> None:
            nonlocal held
            found.append(np.minimum(x, y) * len(names) + np.maximum(x, y))
            of.append(by)
            held += len(x)
            if held > 1_000_000 + len(found[0]):
                once()

        for k in np.unique(length):
            runs = at[length == k]
            if 1 < k <= LEAF:
                step = max(1, 200_000 // int(k * k))
                for s in range(0, len(runs), step):
                    x, y = _pairs_of(runs[s : s + step], int(k))
                    by = lead[x]
                    x, y = node[x], node[y]
                    pair = np.minimum(x, y) * len(names) + np.maximum(x, y)
                    order = np.lexsort((by, pair))
                    pair, by = pair[order], by[order]
                    keep = np.concatenate([[True], pair[1:] != pair[:-1]])
                    pair, by = pair[keep], by[keep]
                    x, y = points.bounded(pair // len(names), pair % len(names), threshold)
                    add(x, y, by[np.searchsorted(pair, x * len(names) + y)])
            elif k > LEAF:
                for r in runs:
                    x, y = rtree_pairs(points, node[r : r + k], threshold)
                    add(x, y, np.full(len(x), lead[r]))
        once()
        pair, by = found[0], leads[of[0]]
        del found, of, points
        K.release()
        for s in range(0, len(pair), 500_000):
            part = pair[s : s + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(by[s : s + 500_000]), pa.array(names[part // len(names)]), pa.array(names[part % len(names)])], ["lead", "a", "b"])

    return run


def cross_pairs(points: Points, left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a left and a right member that the bound lets through; the members of one block among themselves where right is left."""
    alone = right is left
    right = right[np.argsort(points.size[right], kind="stable")]
    size, coarse = points.size[right], points.tables[0][points.place[0][right]]
    full, fine = points.full[right], points.space[right] > 0
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in left:
        own = points.size[i]
        lo, hi = np.searchsorted(size, [threshold * own - 1e-9, own / threshold + 1e-9])
        if lo == hi:
            continue
        bound = np.minimum(coarse[lo:hi], points.tables[0][points.place[0][i]]).sum(1, dtype=np.int32)
        keep = np.flatnonzero((bound >= required(own, size[lo:hi], threshold)) | full[lo:hi] | points.full[i])
        y = right[lo + keep]
        if alone:
            keep, y = keep[y > i], y[y > i]
        x = np.full(len(y), i)
        if points.space[i] > 0 and fine[lo + keep].any():
            x, y = points.bounded(x, y, threshold)
        out_a.append(x)
        out_b.append(y)
    return np.concatenate(out_a), np.concatenate(out_b)


def _block_candidates(threshold: float):
    """Points of whole units, each of one block (side 0) or two (0 and 1), to point pairs (lead, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        table = table.take(pa.compute.sort_indices(table, [("unit", "ascending"), ("side", "ascending"), ("sig", "ascending")]))
        unit = table["unit"].to_numpy()
        at = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]])) if len(unit) else np.zeros(0, np.int64)
        for i, j in zip(at, np.append(at[1:], len(unit))):
            part = table.slice(i, j - i)
            sig, side = part["sig"].to_numpy(), part["side"].to_numpy()
            points = Points(part["size"].to_numpy().astype(np.int64), [zlib.decompress(c, -15) for c in part["counts"].to_pylist()])
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            x, y = cross_pairs(points, left, right if len(right) else left, threshold)
            a, b = np.minimum(sig[x], sig[y]), np.maximum(sig[x], sig[y])
            lead = np.full(len(a), part["lead"][0].as_py())
            for s in range(0, len(a), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[s : s + 500_000]) for v in (lead, a, b)], ["lead", "a", "b"])
        K.release()

    return run


def _wide(slabs: DataFrame) -> DataFrame:
    """(lead, joined, points) of leads with more than WIDE pairs, of their slabs and of all their points alike; joined: all their points are fewer pairs than those of the slabs."""
    apart = slabs.groupBy("lead").agg(F.sum(F.expr("size(sigs) * (size(sigs) - 1D) / 2")).alias("apart")).where(F.col("apart") > WIDE)
    held = slabs.join(apart, "lead").select("lead", "apart", F.explode("sigs").alias("sig")).distinct().groupBy("lead", "apart").agg(F.count(F.lit(1)).alias("points"))
    whole = F.expr("points * (points - 1D) / 2")
    return held.where(whole > WIDE).select("lead", (whole <= F.col("apart")).alias("joined"), "points")


def _blocks(slabs: DataFrame, wide: DataFrame, points: DataFrame) -> DataFrame:
    """Points of wide leads by unit, which is a pair of blocks of a run: of all points of a joined lead, else of a slab.  A unit's lead keeps the upper 48 bits of its own, so a pair that several leads find still goes with the least of them, and the lower 16 tell its units apart."""
    given = slabs.join(wide, "lead")
    joined = given.where("joined").select("lead", F.col("lead").alias("slab"), "points", F.explode("sigs").alias("sig")).distinct()
    apart = given.where("NOT joined").select("lead", "slab", F.size("sigs").cast("long").alias("points"), F.explode("sigs").alias("sig"))
    runs = joined.unionByName(apart).join(points.select("sig", "size", "counts"), "sig").withColumn("blocks", F.ceil(F.col("points") / BLOCK).cast("int"))
    runs = runs.withColumn("own", F.expr("CAST(pmod(xxhash64(sig), blocks) AS INT)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    runs = runs.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    lead = F.col("lead").bitwiseAND(F.lit(~0xFFFF)).bitwiseOR(F.xxhash64("slab", "low", "high").bitwiseAND(F.lit(0xFFFF)))
    return runs.select(F.xxhash64("lead", "slab", "low", "high").alias("unit"), lead.alias("lead"), F.expr("CAST(own > other AS INT)").alias("side"), "sig", "size", "counts")


def _overlaps(key: np.ndarray, off: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common keys of sets x[i] and y[i]; x ascending, keys numbered from 0."""
    size = np.diff(off)
    mark = np.zeros(int(key.max()) + 1 if len(key) else 1, bool)
    out = np.zeros(len(x), np.int64)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    for i, j in zip(at, np.append(at[1:], len(x))):
        own = key[off[x[i]] : off[x[i] + 1]]
        mark[own] = True
        for s in range(i, j, 1000):
            part = y[s : min(s + 1000, j)]
            first = np.cumsum(size[part]) - size[part]
            place = np.repeat(off[part] - first, size[part]) + np.arange(int(size[part].sum()))
            out[s : s + len(part)] = np.add.reduceat(mark[key[place]], first, dtype=np.int64)
        mark[own] = False
    return out


def _verify(n: int, threshold: float, listed: bool):
    """Cogroup of (bucket, sig, rows, text) and (a, b, task): the exact pairs (a, b, common, jaccard) if listed, else (sig, root, links): for each point, one that its links of this bucket lead to, and the rows at their other ends."""

    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("jaccard", pa.float64())] if listed else [("sig", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
        if not texts.num_rows or not pairs.num_rows:
            return schema.empty_table()
        texts = texts.take(pa.array(np.argsort(texts["sig"].to_numpy())))
        sig, rows = texts["sig"].to_numpy(), texts["rows"].to_numpy()
        keys, sizes = [], []
        for chunk in texts["text"].chunks:
            for a, b, data, offsets in K.blocks(chunk):
                hashed, doc, _, _ = K.words(data, offsets)
                gram, off = K.grams(hashed, doc, b - a, n)
                keys.append(gram)
                sizes.append(np.diff(off))
        del texts
        size, key = np.concatenate(sizes), np.concatenate(keys)
        del keys
        # grams as numbers; the order of a set's own keys doesn't matter
        order = np.argsort(key)
        key = key[order]
        number = np.empty(len(key), np.int32)
        number[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]), dtype=np.int32)
        del key, order
        x, y = (np.searchsorted(sig, pairs[c].to_numpy()) for c in ("a", "b"))
        by = np.argsort(x, kind="stable")
        x, y = x[by], y[by]
        overlap = _overlaps(number, np.concatenate([[0], np.cumsum(size)]), x, y)
        del number
        K.release()
        keep = overlap >= required(size[x], size[y], threshold)
        x, y, overlap = x[keep], y[keep], overlap[keep]
        if listed:
            return pa.Table.from_arrays([pa.array(sig[x]), pa.array(sig[y]), pa.array(overlap), pa.array(overlap / (size[x] + size[y] - overlap))], schema=schema)
        links, root = np.bincount(x, rows[y], len(sig)).astype(np.int64) + np.bincount(y, rows[x], len(sig)).astype(np.int64), np.arange(len(sig))
        while True:
            least = root.copy()
            np.minimum.at(least, x, root[y])
            np.minimum.at(least, y, root[x])
            least = least[least]
            if (least == root).all():
                break
            root = least
        some = np.flatnonzero(links)
        return pa.Table.from_arrays([pa.array(sig[some]), pa.array(sig[root[some]]), pa.array(links[some])], schema=schema)

    return run


def _linked(texts: DataFrame, n: int, threshold: float, listed: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of texts with their point, points (sig, id, rows, ...), what _verify finds between points)."""
    spark = texts.sparkSession
    cells, words = _summaries(texts, n)
    summaries = spark.sparkContext.broadcast((cells, words))  # fixed sizes: WORD_CELLS floats, at most n-grams a text / GRAM_SHARE cells
    buckets = storage.partitions(spark)
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    moved = hashed.mapInArrow(_place(n, threshold, buckets, summaries), _MOVED).repartition(buckets, "bucket")
    kept = storage.written(moved.mapInArrow(_slabs, _KEPT), "slabs")
    rows = kept.where("sig IS NOT NULL").select("doc_id", "text_hash", "sig", "size", "counts")
    points = rows.where("size > 0").groupBy("sig").agg(F.min("doc_id").alias("id"), F.min(F.struct("doc_id", "text_hash")).alias("least"), F.count(F.lit(1)).alias("rows"), F.first("size").alias("size"), F.first("counts").alias("counts"))
    # slabs of one group of near copies mostly share their least member; by it they meet in one task, which finds a pair once
    every = storage.written(kept.where("slab IS NOT NULL").dropDuplicates(["slab"]).select("slab", F.array_min("sigs").alias("lead"), "sigs"), "slabs")
    wide = storage.written(_wide(every), "wide")
    some = not wide.isEmpty()
    slabs = (every.join(wide, "lead", "left_anti") if some else every).select("slab", "lead", F.explode("sigs").alias("sig"))
    points_of = slabs.select("lead", "sig").distinct().join(points.select("sig", "size", "counts"), "sig").select("lead", F.lit(None).cast("long").alias("slab"), "sig", "size", "counts")
    members = slabs.select("lead", "slab", "sig", F.lit(None).cast("int").alias("size"), F.lit(None).cast("binary").alias("counts")).unionByName(points_of)
    found = members.repartition(buckets, "lead").mapInArrow(_candidates(threshold), "lead long, a long, b long")
    if some:
        found = found.unionByName(_blocks(every, wide, points).repartition(buckets, "unit").mapInArrow(_block_candidates(threshold), "lead long, a long, b long"))
    bucket = F.pmod(F.xxhash64(F.min("lead")), F.lit(buckets)).cast("int").alias("bucket")
    candidates = storage.written(found.groupBy("a", "b").agg(bucket), "candidates")
    wanted = candidates.select("bucket", F.explode(F.array("a", "b")).alias("sig")).distinct().join(points.select("sig", "rows", F.col("least.doc_id").alias("of_id"), F.col("least.text_hash").alias("of_text")), "sig")
    sides = hashed.join(wanted, (hashed["text_hash"] == wanted["of_text"]) & hashed["doc_id"].eqNullSafe(wanted["of_id"])).select("bucket", "sig", "rows", "text").dropDuplicates(["bucket", "sig"])
    verified = sides.groupBy("bucket").cogroup(candidates.withColumnRenamed("bucket", "task").groupBy("task")).applyInArrow(_verify(n, threshold, listed), "a long, b long, common long, jaccard double" if listed else "sig long, root long, links long")
    return rows, points, verified


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links) of every row; see the module's text."""
    texts = docs.where("text IS NOT NULL").select("doc_id", F.lower("text").alias("text"))
    rows, points, verified = _linked(texts, n, threshold, False)
    found = storage.written(verified, "links")
    component = graph.components(found, "sig", "root").withColumnRenamed("node", "sig")
    links = found.groupBy("sig").agg(F.sum("links").alias("links"))
    known = points.select("sig", "id", "rows").join(component, "sig", "left").join(links, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    named = known.groupBy("component").agg(F.min("id").alias("class_id"))
    known = known.join(named, "component").select("sig", "class_id", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    alone = lambda rows: rows.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return rows.where("size > 0").select("doc_id", "sig").join(known, "sig").select("doc_id", "class_id", "links").unionByName(alone(rows.where("size = 0"))).unionByName(alone(docs.where("text IS NULL")))


def jaccard_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, expand: bool = False) -> DataFrame:
    """(doc_a, doc_b, jaccard); see the module's text."""
    rows, points, verified = _linked(_texts(docs), n, threshold, True)
    near = verified.withColumn("jaccard", F.round("jaccard", 6))
    ids = rows.where("size > 0").select("sig", "doc_id").distinct() if expand else points.select("sig", F.col("id").alias("doc_id"))
    side = lambda name: ids.select(F.col("sig").alias(name), F.col("doc_id").alias(f"id_{name}"))
    near = near.join(side("a"), "a").join(side("b"), "b").where("id_a <> id_b").select(F.least("id_a", "id_b").alias("doc_a"), F.greatest("id_a", "id_b").alias("doc_b"), "jaccard")
    if expand:
        copies = side("a").join(side("b"), F.col("a") == F.col("b")).where("id_a < id_b").select(F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    else:
        copies = _copies(rows, points).withColumn("jaccard", F.lit(1.0))
    return near.unionByName(copies).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def _copies(rows: DataFrame, points: DataFrame) -> DataFrame:
    """(doc_a, doc_b): least id and other ids of each point."""
    return rows.join(points.select("sig", F.col("id").alias("doc_a")), "sig").where("doc_id <> doc_a").select("doc_a", F.col("doc_id").alias("doc_b")).distinct()


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Documents without all but the least id of each connected group of near copies; all other rows stay as they are."""
    rows, points, verified = _linked(_texts(docs), n, threshold, False)
    return docs.join(_groups(rows, points, verified).where("node <> component").select(F.col("node").alias("doc_id")), "doc_id", "left_anti")


def _groups(rows: DataFrame, points: DataFrame, verified: DataFrame) -> DataFrame:
    """(node, component): ids that links or copies connect, and the least of them."""
    ids = points.select("sig", "id")
    near = verified.select("sig", "root").distinct().join(ids.withColumnRenamed("id", "doc_a"), "sig").join(ids.withColumnsRenamed({"sig": "root", "id": "doc_b"}), "root").select("doc_a", "doc_b")
    return graph.components(near.unionByName(_copies(rows, points)), "doc_a", "doc_b")


def groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component) of ids with a link or a copy; pairs aren't listed for it."""
    return _groups(*_linked(_texts(docs), n, threshold, False))


def counted_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, common, jaccard) of points, by their least ids, and of each point's least id with its other ids."""
    rows, points, verified = _linked(_texts(docs), n, threshold, True)
    side = lambda name: points.select(F.col("sig").alias(name), F.col("id").alias(f"id_{name}"))
    near = verified.join(side("a"), "a").join(side("b"), "b").where("id_a <> id_b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "common", "jaccard")
    same = rows.join(points.select("sig", "id", F.col("size").cast("long").alias("common")).withColumnRenamed("sig", "of"), F.col("sig") == F.col("of")).where("doc_id <> id")
    return near.unionByName(same.select(F.col("id").alias("a"), F.col("doc_id").alias("b"), "common", F.lit(1.0).alias("jaccard")).distinct())


def oracle_sql(n: int = N, threshold: float = THRESHOLD) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct([{gram} FOR i IN range(1, len(w) - {n - 2})])) END AS g FROM words WHERE len(w) > 0),
points AS (SELECT row_number() OVER () AS p, id, g, size, n FROM (SELECT min(doc_id) AS id, g, len(g) AS size, count(*) AS n FROM sets GROUP BY g)),
grams AS (SELECT p, size, n, unnest(g) AS gram FROM points),
near AS MATERIALIZED (SELECT a.p AS a, b.p AS b, b.n FROM grams a JOIN grams b ON a.gram = b.gram AND a.p <> b.p GROUP BY a.p, b.p, a.size, b.size, b.n HAVING count(*) >= ceil({threshold} / (1 + {threshold}) * (a.size + b.size) - 1e-9)),
reach AS (SELECT p AS a, p AS b FROM points UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
classes AS (SELECT reach.a AS p, min(points.id) AS class_id FROM reach JOIN points ON reach.b = points.p GROUP BY reach.a),
links AS (SELECT a AS p, sum(n) AS n FROM near GROUP BY a)
SELECT s.doc_id, c.class_id, CAST(p.n - 1 + coalesce(l.n, 0) AS BIGINT) AS links FROM sets s JOIN points p USING (g) JOIN classes c ON c.p = p.p LEFT JOIN links l ON l.p = p.p
UNION ALL SELECT doc_id, doc_id, CAST(0 AS BIGINT) FROM words WHERE w IS NULL OR len(w) = 0"""
