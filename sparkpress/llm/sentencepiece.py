"""Operator 5, SentencePiece encoding and decoding: a relational Viterbi lattice.

The vocabulary is a SentencePiece model file; its pieces' scores are used as a
unigram model's, that is, a text is cut into the pieces whose scores have the
greatest sum (ties: the longest last piece, as the library's own search does).
Spaces are written as U+2581, one is put before a text that isn't empty, and
characters without a piece become byte pieces.

1. **Segments.**  Pieces that no best path can hold, since other pieces that spell
   the same have a greater sum, are left out.  A text is cut wherever no piece
   spans: between two bytes that are neighbours in no piece.  This is exact, and leaves short segments, words
   with their leading space for the most part, that repeat all over the corpus.
   Texts are scanned as bytes; a segment is named by a 64-bit hash, and each
   distinct segment of a task is spelled out once.
2. **Lattice.**  For each distinct segment of the corpus the substrings of up to
   the longest piece's length are exploded, equi-joined to the piece table,
   grouped by segment in blocks of positions, and folded from left to right by
   ``aggregate``, which carries the best score and last piece of each position; a
   walk back from the last one gives the path.
3. **Texts.**  The results go back to the tasks whose texts have the segments,
   as one written table partitioned by task, so that nothing is broadcast that
   grows with the corpus and texts are never shuffled.  Each task reads its own
   part, encodes its texts, decodes them again and compares.  A segment missing
   from the part (a retried scan that was cut differently), and those of a text
   that isn't the decoded one (two segments of one hash), are folded on the spot.

Result of :func:`encode`: (doc_id, n_pieces, ids, round_trip), ids being int
arrays.  :func:`decode` is the inverse.

Defined cases: a null text has null ids, null n_pieces and null round_trip; an
empty one no ids; a literal U+2581 is a space; of paths with equal sums the one
with the longest last piece, then the longest before it, is taken; a very long
text or run without a cut is encoded like any other; rows are kept as they are,
repeated or with null ids; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from . import textkernel as K

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Positions in a window of a long segment, and in a block of the fold.
WINDOW, CHUNK = 64, 256
#: Bytes of text that a task works on at once.
BLOCK = 1 << 18
#: Pieces with a score this low stand for no probability at all and are never used.
NEVER = -1e8
SPACE = "▁"


class Spelling:
    """The bytes of each piece, without the model."""

    def __init__(self, spelled: list[bytes], byte_pieces: np.ndarray):
        self.mark = byte_pieces[np.frombuffer(SPACE.encode(), np.uint8)]
        self.size = np.array([len(s) for s in spelled], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.space = int(self.size.sum())
        self.spelling = np.frombuffer(b"".join(spelled) + b" ", np.uint8)

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the pieces in a row, bytes of each); the byte pieces of U+2581 are a space."""
        size, start = self.size[ids], self.start[ids]
        spaces = np.flatnonzero((ids[:-2] == self.mark[0]) & (ids[1:-1] == self.mark[1]) & (ids[2:] == self.mark[2])) if len(ids) > 2 else np.zeros(0, np.int64)
        start[spaces], size[spaces + 1], size[spaces + 2] = self.space, 0, 0
        at = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
        return self.spelling[at], size


class Pieces:
    """The piece table of a model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.unknown, self.bytes = model.unk_id(), np.full(256, model.unk_id(), np.int32)
        self.table: dict[str, tuple[int, float]] = {}
        for i in range(model.get_piece_size()):
            piece, score = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or score <= NEVER):
                self.table[piece.replace(SPACE, " ")] = (i, score)
        self.longest = max(map(len, self.table), default=1)
        self.unknown_score = min((s for _, s in self.table.values()), default=0.0) - 10.0
        spelled = [b""] * model.get_piece_size()
        for piece, (i, _) in self.table.items():
            spelled[i] = piece.encode()
        for byte, i in enumerate(self.bytes):
            if i != self.unknown:
                spelled[i] = bytes([byte])
        self.spelling = Spelling(spelled, self.bytes)

    @functools.cached_property
    def used(self) -> dict[str, tuple[int, float]]:
        """The pieces that a best path can hold: all but those of which other pieces in a row have a greater sum, by more than rounding can hide."""
        return {piece: x for piece, x in self.table.items() if self.apart(piece) <= x[1] + 1e-6 * (1 + abs(x[1]))}

    def apart(self, text: str) -> float:
        """The greatest sum of two or more pieces that spell the text."""
        best = [0.0]
        for end in range(1, len(text) + 1):
            top = -np.inf
            for begin in range(max(0, end - self.longest), end):
                piece = self.table.get(text[begin:end])
                if piece is not None and best[begin] + piece[1] > top and end - begin < len(text):
                    top = best[begin] + piece[1]
            best.append(top)
        return best[-1]

    @functools.cached_property
    def spans(self) -> np.ndarray:
        """Whether a used piece holds the two bytes side by side."""
        spans = np.zeros(65536, bool)
        for piece in self.used:
            raw = np.frombuffer(piece.encode(), np.uint8).astype(np.int64)
            spans[raw[:-1] << 8 | raw[1:]] = True
        follow = np.arange(65536) & 0xC0
        spans[follow == 0x80] = True  # never inside a character
        return spans

    def fold(self, text: str) -> list[int]:
        """The best path through one segment, in time linear in its length."""
        best, back = [0.0], [0]
        for end in range(1, len(text) + 1):
            top, choice = best[end - 1] + self.table.get(text[end - 1], (0, self.unknown_score))[1], end - 1
            for begin in range(max(0, end - self.longest), end - 1):
                piece = self.table.get(text[begin:end])
                if piece is not None and (best[begin] + piece[1] > top or (best[begin] + piece[1] == top and begin < choice)):
                    top, choice = best[begin] + piece[1], begin
            best.append(top)
            back.append(choice)
        ids: list[int] = []
        while end := len(back) - 1:
            begin = back[end]
            piece = self.table.get(text[begin:end])
            ids += [piece[0]] if piece else self.bytes[np.frombuffer(text[begin:end].replace(" ", SPACE).encode(), np.uint8)][::-1].tolist()
            del back[begin + 1 :]
        return ids[::-1]


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def segments(data: np.ndarray, offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, first byte, bytes) of each segment of texts that stand one after another."""
    if not len(data):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    edge = np.ones(len(data), bool)
    edge[1:] = ~spans[data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(edge)
    length = np.diff(start, append=len(data))
    hashed = K.runs(data, None, start, start, length)
    return hashed, np.searchsorted(offsets, start, "right") - 1, start, length


def _prepared(docs: DataFrame) -> DataFrame:
    """A space before each text that isn't empty; U+2581 is a space."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text") == "", "").otherwise(F.concat(F.lit(" "), F.translate("text", SPACE, " "))).alias("text"))


def lattice(spark: SparkSession, words: DataFrame, model: str) -> DataFrame:
    """(hash, ids array<int>) of distinct (hash, segment), by the relational lattice."""
    given = pieces(model)
    table = spark.createDataFrame([(p, i, float(s)) for p, (i, s) in given.used.items()], "piece string, id int, score double")
    longest = max(map(len, given.used), default=1)
    # placed by hash once: the explosions and the join keep that placement, so that the grouping moves no edges
    placed = words.repartition(storage.partitions(spark), "hash").where("segment <> ''")
    # a long segment goes in windows, so that the cost of spelling substrings is linear in its length
    window = placed.select("hash", "segment", F.length("segment").alias("n"), F.explode(F.expr(f"sequence(0, CAST((length(segment) - 1) div {WINDOW} AS int))")).alias("w"))
    window = window.select("hash", "n", "w", F.expr(f"greatest(0, w * {WINDOW} - {longest - 1})").alias("skip"), "segment").select("hash", "n", "w", "skip", F.expr(f"substring(segment, skip + 1, (w + 1) * {WINDOW} - skip)").alias("part_of"))
    ends = window.select("hash", "skip", "part_of", F.explode(F.expr(f"sequence(w * {WINDOW} + 1, least(n, (w + 1) * {WINDOW}))")).alias("e"))
    # every substring that can be a piece, longest first; a single character always, since it is an edge even if unknown
    parts = ends.select("hash", "skip", "part_of", "e", F.explode(F.expr(f"sequence(greatest(0, e - {longest}), e - 1)")).alias("b")).select("hash", "e", "b", F.expr("substring(part_of, b - skip + 1, e - b)").alias("part"))
    # the piece table is a model's, tens of thousands of rows whatever the corpus; numbers are looked up faster than strings
    keyed = table.withColumn("key", F.xxhash64("piece"))
    edges = parts.join(F.broadcast(keyed), (F.xxhash64("part") == F.col("key")) & (F.col("part") == F.col("piece")), "left").where("id IS NOT NULL OR b = e - 1")
    # what an edge does: 65536 times its piece (an unknown character's is its code point, below zero), and its length
    does = F.coalesce("id", F.expr(f"CASE WHEN part = ' ' THEN -{ord(SPACE)} ELSE -ascii(part) END")).cast("long") * 65536 + (F.col("e") - F.col("b"))
    # i: where the fold has the best path to the edge's begin
    edge = F.struct("e", F.expr(f"b - greatest(0, CAST((e - 1) div {CHUNK} AS int) * {CHUNK} + {1 - longest})").alias("i"), F.coalesce("score", F.lit(given.unknown_score)).alias("s"), does.alias("v"))
    grouped = edges.groupBy("hash").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    # kept: of the positions so far, those that the next block sees; full, last: the last edges of a block's positions
    whole = "concat(r.w, array(r.t))"
    kept = f"slice({whole}, greatest(1, size(r.w) + {2 - longest}), {longest})"
    block = lambda n: f"transform(slice({whole}, size(r.w) + 2 - ({n}), {n}), z -> z.v)"
    full, last = block(str(CHUNK)), block(f"(r.e - 1) % {CHUNK} + 1")
    # aggregate copies what it carries at each step, so of the positions before the current block of CHUNK only those in reach stay in w, the best path (score s, last edge v)
    # to each position, and a full block's edges go to p; t: the best path so far to position e.  Edges come by end, longest first, and only a better one replaces another
    best = grouped.select("hash", F.expr(f"""aggregate(edges, named_struct('w', CAST(array() AS array<struct<s: double, v: bigint>>), 'e', 0, 't', named_struct('s', 0D, 'v', 0L), 'p', CAST(array() AS array<array<bigint>>)),
      (r, x) -> CASE
        WHEN x.e = r.e THEN IF(get(r.w, x.i).s + x.s > r.t.s, named_struct('w', r.w, 'e', r.e, 't', named_struct('s', get(r.w, x.i).s + x.s, 'v', x.v), 'p', r.p), r)
        WHEN r.e = 0 OR r.e % {CHUNK} > 0 THEN named_struct('w', concat(r.w, array(r.t)), 'e', x.e, 't', named_struct('s', coalesce(get(r.w, x.i).s, r.t.s) + x.s, 'v', x.v), 'p', r.p)
        ELSE named_struct('w', {kept}, 'e', x.e, 't', named_struct('s', get({kept}, x.i).s + x.s, 'v', x.v), 'p', concat(r.p, array({full}))) END,
      r -> concat(r.p, array({last})))""").alias("best"))
    walked = best.select("hash", F.expr("""reverse(flatten(aggregate(reverse(best), named_struct('skip', 0L, 'ids', CAST(array() AS array<array<int>>)),
      (a, y) -> aggregate(reverse(y), named_struct('skip', a.skip, 'ids', CAST(array() AS array<int>)),
        (r, v) -> CASE WHEN r.skip > 0 THEN named_struct('skip', r.skip - 1, 'ids', r.ids) WHEN v = 0 THEN r ELSE named_struct('skip', (v & 65535) - 1, 'ids', concat(r.ids, array(CAST(shiftright(v, 16) AS int)))) END,
        r -> named_struct('skip', r.skip, 'ids', concat(a.ids, array(r.ids)))),
      a -> a.ids)))""").alias("ids"))
    byte = lambda x: f"element_at(array({', '.join(map(str, given.bytes.tolist()))}), CAST({x} AS int) + 1)"
    more = lambda shift: byte(f"128 + (shiftright(-i, {shift}) & 63)")
    spelled = f"""flatten(transform(ids, i -> CASE WHEN i >= 0 THEN array(i) WHEN i > -128 THEN array({byte("-i")}) WHEN i > -2048 THEN array({byte("192 + shiftright(-i, 6)")}, {more(0)})
      WHEN i > -65536 THEN array({byte("224 + shiftright(-i, 12)")}, {more(6)}, {more(0)}) ELSE array({byte("240 + shiftright(-i, 18)")}, {more(12)}, {more(6)}, {more(0)}) END))"""
    return walked.select("hash", F.expr(f"CASE WHEN exists(ids, i -> i < 0) THEN {spelled} ELSE ids END").alias("ids"))


def _spelled(spans: np.ndarray):
    """Each distinct segment of a task, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, fresh = TaskContext.get().partitionId(), np.zeros(0, np.uint64), []
        for batch in batches:
            for _, _, data, offsets in K.blocks(batch.column(1), max_bytes=BLOCK):
                hashed, _, start, length = segments(data, offsets, spans)
                found, at = np.unique(hashed, return_index=True)
                for known in (seen, *fresh):
                    if len(known):
                        new = known[np.minimum(np.searchsorted(known, found), len(known) - 1)] != found
                        found, at = found[new], at[new]
                fresh.append(found)
                if len(fresh) >= 16:
                    seen, fresh = np.sort(np.concatenate([seen, *fresh])), []
                size = length[at]
                ends = np.cumsum(size)
                chars = data[np.arange(int(size.sum())) + np.repeat(start[at] - (ends - size), size)]
                text = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(chars)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), task, np.int32)), pa.array(found.view(np.int64)), text], ["task", "hash", "segment"])
            K.release()
        del seen, fresh
        K.release()

    return run


def _part(path: str, task: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending hashes, first id of each, ids) of a task's part of the written results."""
    filesystem, root = pyarrow.fs.FileSystem.from_uri(path)
    folder = f"{root}/task={task}"
    if filesystem.get_file_info(folder).type != pyarrow.fs.FileType.Directory:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)
    files = sorted(f.path for f in filesystem.get_file_info(pyarrow.fs.FileSelector(folder)) if f.path.endswith(".parquet"))
    # not pyarrow.dataset, which imports pandas: 31 MB in each worker
    table = pa.concat_tables([pyarrow.parquet.ParquetFile(filesystem.open_input_file(f)).read(columns=["hash", "ids"], use_threads=False) for f in files]).combine_chunks()
    if not np.all(np.diff(table["hash"].to_numpy()) >= 0):  # more than one file
        table = table.sort_by("hash").combine_chunks()
    hashed, lists = table["hash"].combine_chunks(), table["ids"].combine_chunks()
    hashed, lists = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (hashed, lists))
    # hashes are stored as signed numbers: sorted as such, and searched as such
    return hashed.to_numpy(), lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()


def _encoded(model: str, spans: np.ndarray, spelling: Spelling, path: str):
    """A worker loads the model only for a segment or a text that it has to fold itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = lambda raw: pieces(model).fold(raw.tobytes().decode())
        known, first, flat = _part(path, TaskContext.get().partitionId())
        size = np.diff(first)
        for batch in batches:
            for a, b, data, offsets in K.blocks(batch.column(1), max_bytes=BLOCK):
                hashed, doc, start, length = segments(data, offsets, spans)
                hashed = hashed.view(np.int64)
                at = np.minimum(np.searchsorted(known, hashed), max(len(known) - 1, 0))
                hit = known[at] == hashed if len(known) else np.zeros(len(hashed), bool)
                count = np.where(hit, size[at], 0) if len(known) else np.zeros(len(hashed), np.int64)
                missing = {int(i): fold(data[start[i] : start[i] + length[i]]) for i in np.flatnonzero(~hit)}
                for i, path_ in missing.items():
                    count[i] = len(path_)
                begin = np.cumsum(count) - count
                ids = np.empty(int(count.sum()), np.int32)
                if len(known):
                    many = np.where(hit, count, 0)
                    place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                    ids[np.repeat(begin, many) + place] = flat[np.repeat(first[at], many) + place]
                for i, path_ in missing.items():
                    ids[begin[i] : begin[i] + count[i]] = path_
                per = np.bincount(doc, count, b - a).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(per)])
                spelled, width = spelling.spell(ids)
                reach = np.concatenate([[0], np.cumsum(width)])[ends]
                same = np.diff(reach) == np.diff(offsets)
                if same.all():
                    wrong = np.concatenate([[0], np.cumsum(spelled != data)])
                    same = wrong[offsets[1:]] == wrong[offsets[:-1]]
                else:
                    same &= np.array([np.array_equal(spelled[reach[i] : reach[i + 1]], data[offsets[i] : offsets[i + 1]]) for i in range(b - a)])
                if not same.all():  # two segments of one hash, or a character that the pieces can't spell: these texts' segments are folded here
                    own = {int(i): np.array([p for j in np.flatnonzero(doc == i) for p in fold(data[start[j] : start[j] + length[j]])], np.int32) for i in np.flatnonzero(~same)}
                    texts = [own.get(i, ids[ends[i] : ends[i + 1]]) for i in range(b - a)]
                    for i, x in own.items():
                        same[i] = np.array_equal(spelling.spell(x)[0], data[offsets[i] : offsets[i + 1]])
                    ids, per = np.concatenate(texts), np.array([len(x) for x in texts])
                    ends = np.concatenate([[0], np.cumsum(per)])
                null = np.array(batch.column(1).slice(a, b - a).is_null())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(per, mask=null), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids), mask=pa.array(null)), pa.array(same, mask=null)], ["doc_id", "n_pieces", "ids", "round_trip"])
        del known, first, flat
        K.release()

    return run


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) for every row of docs."""
    spark = docs.sparkSession
    texts = _prepared(docs)
    spelled = texts.mapInArrow(_spelled(pieces(model).spans), "task int, hash long, segment string")
    words = storage.written(spelled.groupBy("hash").agg(F.first("segment").alias("segment"), F.collect_set("task").alias("tasks")), "words")
    found = lattice(spark, words.select("hash", "segment"), model).join(words.select("hash", "tasks"), "hash")
    path = storage.new_path(spark, "segments")
    # by sorting: the other aggregate falls back to it after 128 segments, at each of its steps anew
    with storage.shuffles_freed(spark), storage.setting(spark, "spark.sql.execution.useObjectHashAggregateExec", "false"):
        found.select("hash", "ids", F.explode("tasks").alias("task")).repartition(storage.partitions(spark), "task").sortWithinPartitions("task", "hash").write.partitionBy("task").parquet(path)
    return texts.mapInArrow(_encoded(model, pieces(model).spans, pieces(model).spelling, path), "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): null ids give a null text, unknown ids are skipped."""
    spelling = pieces(model).spelling

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = []
            for ids in batch.column(1).to_pylist():
                if ids is None:
                    text.append(None)
                    continue
                good = np.array([i for i in ids if i is not None and 0 <= i < len(spelling.size)], np.int64)
                spelled = spelling.spell(good)[0].tobytes().decode(errors="replace")
                text.append(spelled[1:] if spelled.startswith(" ") else spelled)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
