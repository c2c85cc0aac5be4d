"""Operator 2, WARC: a two-level capture index.

Level one: one line for each capture, ordered by its sort-friendly URL key (host
labels reversed, so that a domain's captures are neighbours) and id, in blocks of
``BLOCK_LINES`` lines that are compressed one by one and stand one after another
in shard files, one for each range partition.  Level two: a sparse directory
with one row for each block: its first and last key, offset and length.

A lookup routes each distinct key to its shards by binary search in the shards'
first keys, finds the blocks by binary search in the shard's part of the
directory, reads only these byte ranges, decompresses them, and finds the lines
by binary search.  A key whose captures fill several blocks or shards is found in
all of them.

Shards are written to the shared folder under names that no two task attempts
share, and only committed tasks' rows enter the directory, so a lost executor or
a second attempt leaves no wrong entry.

Result of :func:`lookup`: (page_id, urlkey, capture_id, digest, length) for each
row that asks and each capture of its key.

Defined cases: a null url has no key: it isn't indexed and finds nothing; a url
without a scheme has an empty host and itself as path; fragments, user names,
``www`` and the default ports don't matter; null ids are indexed and order
first; repeated rows are captures of their own; a null html has a null digest and
length; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

BLOCK_LINES = 1000
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"
_HOST = f"{_SCHEME}(?:[^/?#@]*@)?([^/?#:]*)"
_PORT = f"{_SCHEME}(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)"
_PATH = f"{_SCHEME}[^/?#]*([^#]*)"
_DIRECTORY = "shard string, block int, first_key binary, last_key binary, offset long, length long, lines int"


def url_key(url: str, duck: bool = False) -> str:
    """SQL expression of the key of a url column."""
    host = f"regexp_replace(lower(regexp_extract({url}, '{_HOST}', 1)), '^www[0-9]*[.]', '')"
    labels = f"array_to_string(list_reverse(string_split({host}, '.')), ',')" if duck else f"array_join(reverse(split({host}, '[.]')), ',')"
    port = f"CASE WHEN regexp_extract({url}, '{_PORT}', 1) IN ('', '80', '443') THEN '' ELSE concat(':', regexp_extract({url}, '{_PORT}', 1)) END"
    matches = f"regexp_matches({url}, '{_SCHEME}')" if duck else f"{url} RLIKE '{_SCHEME}'"
    path = f"CASE WHEN NOT {matches} THEN regexp_extract({url}, '^[^#]*', 0) WHEN regexp_extract({url}, '{_PATH}', 1) LIKE '/%' THEN regexp_extract({url}, '{_PATH}', 1) ELSE concat('/', regexp_extract({url}, '{_PATH}', 1)) END"
    return f"CASE WHEN {url} IS NULL THEN NULL ELSE concat({labels}, {port}, ')', {path}) END"


class Index(NamedTuple):
    """The directory, and the shards in order as (path, first key, last key)."""

    directory: DataFrame
    shards: list[tuple[str, bytes, bytes]]


def _line(key: bytes, page: int | None, digest: str | None, length: int | None) -> bytes:
    """Keys hold no control characters that could end a field: they are written as %XX."""
    return b"\t".join([key, *(b"" if v is None else str(v).encode() for v in (page, digest, length))])


def _write(folder: str, block_lines: int):
    names = [c.split()[0] for c in _DIRECTORY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = pyarrow.fs.FileSystem.from_uri(folder)
        path = f"{root}/shard-{uuid.uuid4().hex}.cdx"
        out, rows, held, offset = None, [], [], 0

        def flush() -> None:
            nonlocal out, offset
            if out is None:
                filesystem.create_dir(root)
                out = filesystem.open_output_stream(path)
            packed = zlib.compress(b"\n".join(line for _, line in held), 6)
            out.write(packed)
            rows.append((path, len(rows), held[0][0], held[-1][0], offset, len(packed), len(held)))
            offset += len(packed)
            held.clear()

        for batch in batches:
            for key, *fields in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((key, _line(key, *fields)))
                if len(held) == block_lines:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            columns = zip(*rows)
            types = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def _keyed(table: DataFrame, *columns) -> DataFrame:
    safe = F.regexp_replace(F.expr(url_key("url")), r"[\t\n]", "%0A")
    return table.where("url IS NOT NULL").select(F.encode(safe, "UTF-8").alias("key"), *columns)


def build(pages: DataFrame, block_lines: int = BLOCK_LINES) -> Index:
    """Sort the captures of pages (page_id, url, html) into shards."""
    spark = pages.sparkSession
    lines = _keyed(pages, F.col("page_id").cast("long").alias("page_id"), F.md5("html").alias("digest"), F.octet_length("html").cast("long").alias("length"))
    ordered = lines.repartitionByRange(storage.partitions(spark), "key", F.col("page_id").asc_nulls_first()).sortWithinPartitions("key", F.col("page_id").asc_nulls_first(), "digest")
    directory = storage.written(ordered.mapInArrow(_write(storage.new_path(spark, "captures"), block_lines), _DIRECTORY), "directory")
    # one row a shard, that is a task's output
    shards = directory.groupBy("shard").agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key")).orderBy("first_key", "last_key").collect()
    return Index(directory, [(r.shard, bytes(r.first_key), bytes(r.last_key)) for r in shards])


def find_blocks(first: list[bytes], last: list[bytes], key: bytes) -> range:
    """Positions whose ranges of keys, in order, hold key."""
    return range(bisect_left(last, key), bisect_right(first, key))


def lookup(index: Index, queries: DataFrame, folder: str) -> DataFrame:
    """(page_id, urlkey, capture_id, digest, length) of all captures of each row's (page_id, url) key."""
    spark = queries.sparkSession
    shards = spark.sparkContext.broadcast(index.shards)
    asked = _keyed(queries, F.col("page_id").cast("long").alias("page_id"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = [s[1] for s in shards.value], [s[2] for s in shards.value]
        for batch in batches:
            found = [(shards.value[i][0], key) for key in batch.column(0).to_pylist() for i in find_blocks(first, last, key)]
            names, keys = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys, pa.binary())], ["shard", "key"])

    schema = pa.schema([("key", pa.binary()), ("capture_id", pa.int64()), ("digest", pa.string()), ("length", pa.int64())])

    def read(wanted: pa.Table, blocks: pa.Table) -> pa.Table:
        if not wanted.num_rows or not blocks.num_rows:
            return schema.empty_table()
        blocks = blocks.sort_by("block").to_pydict()
        filesystem, _ = pyarrow.fs.FileSystem.from_uri(folder)
        need: dict[int, list[bytes]] = {}
        for key in wanted["key"].to_pylist():
            for i in find_blocks(blocks["first_key"], blocks["last_key"], key):
                need.setdefault(i, []).append(key)
        rows = []
        with filesystem.open_input_file(blocks["shard"][0]) as file:
            for i, keys in sorted(need.items()):
                lines = [line.split(b"\t") for line in zlib.decompress(file.read_at(blocks["length"][i], blocks["offset"][i])).split(b"\n")]
                names = [line[0] for line in lines]
                for key in keys:
                    rows += [(key, *(f or None for f in line[1:])) for line in lines[bisect_left(names, key) : bisect_right(names, key)]]
        key, page, digest, length = zip(*rows) if rows else ((),) * 4
        whole = lambda c: pa.array([None if v is None else int(v) for v in c], pa.int64())
        return pa.Table.from_arrays([pa.array(key, pa.binary()), whole(page), pa.array([None if d is None else d.decode() for d in digest], pa.string()), whole(length)], schema=schema)

    routed = asked.select("key").distinct().mapInArrow(route, "shard string, key binary")
    found = routed.groupBy("shard").cogroup(index.directory.groupBy("shard")).applyInArrow(read, "key binary, capture_id long, digest string, length long")
    return asked.join(found, "key").select("page_id", F.decode("key", "UTF-8").alias("urlkey"), "capture_id", "digest", "length")


def captures(pages: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Index all pages, and look up the url of each of them."""
    return lookup(build(pages, block_lines), pages.select("page_id", "url"), storage.shared_dir(pages.sparkSession))


def oracle_sql() -> str:
    key = url_key("url", duck=True)
    return f"""WITH keyed AS (SELECT page_id, regexp_replace({key}, '[\\t\\n]', '%0A', 'g') AS urlkey, md5(html) AS digest, CAST(strlen(html) AS BIGINT) AS length FROM pages WHERE url IS NOT NULL)
SELECT a.page_id, a.urlkey, b.page_id AS capture_id, b.digest, b.length FROM keyed a JOIN keyed b ON a.urlkey = b.urlkey"""
