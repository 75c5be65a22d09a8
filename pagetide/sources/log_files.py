"""Sources over a bucket's files: manifest, headers, pages, page index, verification, write-ahead logs, listing and stream lines.

Listings carry no contents. What else is read of a file is read by range in the task that needs it: 100 bytes for a header, the
tail for an index, a frame for a page. A broken file is a row with an error wherever the source has such a column.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.columns import HEADER_SIZE, NAME, SNAPSHOT_LEVEL, name_part, unhex16
from .store import Store

#: Pages in one batch of rows.
MOST_PAGES = 1024


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, name, level, length and modificationTime of all files below root."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = F.element_at(F.split("path", "/"), -1)
    level = F.element_at(F.split("path", "/"), -2)
    return df.select("path", tail.alias("name"), F.when(level.rlike("^0{0,3}[0-9]$"), level.cast("int")).alias("level"), "length", "modificationTime")


def manifest(spark: SparkSession, root: str, seek: int = 0, exact_time: bool = False) -> DataFrame:
    """A row for each log file; stray names, files shorter than a header and ranges that are none are skipped.

    created_at is the file's time in the store or, with exact_time, the header's, which costs a read of 100 bytes a file.
    """
    df = files(spark, root).where(F.col("name").rlike(NAME) & F.col("level").isNotNull() & (F.col("length") >= HEADER_SIZE))
    out = df.select("level", name_part(F.col("name"), 1).alias("min_txid"), name_part(F.col("name"), 2).alias("max_txid"), F.col("length").alias("size"), F.col("modificationTime").alias("created_at"), "path")
    out = out.where((F.col("min_txid") >= seek) & (F.col("min_txid") > 0) & (F.col("min_txid") <= F.col("max_txid")))
    if exact_time:
        times = _headers_of(out.select("path")).where("error is null").select("path", F.timestamp_millis("ts_ms").alias("exact"))
        out = out.join(times, "path", "left").withColumn("created_at", F.coalesce("exact", "created_at")).select(*out.columns)
    return out


def _place(path: str) -> tuple[Store, str]:
    folder, _, name = path.rpartition("/")
    return Store(folder), name


def read(path: str, offset: int = 0, size: int | None = None) -> bytes:
    """A file, or a range of it, by the path that a listing gives; a size of 0 reads to the end."""
    store, name = _place(path)
    return store.get(name, offset, size or None)


def size_of(path: str) -> int:
    store, name = _place(path)
    return store.size(name)


def _per_file(names: list[str], of_file: Callable[[str], Iterator[tuple]]) -> Callable:
    """A function for mapInPandas: the rows of each file; a missing or broken one gives a single row (path, ..., error) if error is a column."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                held: list[tuple] = []
                try:
                    for row in of_file(path):
                        held.append(row)
                        if len(held) == MOST_PAGES:
                            yield pd.DataFrame(held, columns=names)
                            held = []
                except (codec.FormatError, OSError, struct.error) as e:
                    if names[-1] != "error":
                        raise
                    held.append((path, *[None] * (len(names) - 2), str(e)))
                if held:
                    yield pd.DataFrame(held, columns=names)

    return rows


def _mapped(paths: DataFrame, schema: str, of_file: Callable[[str], Iterator[tuple]]) -> DataFrame:
    fields = [f.split() for f in schema.split(", ")]
    whole = {n for n, t in fields if t in ("long", "int")}
    rows = _per_file([n for n, _ in fields], of_file)

    def typed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows(batches):
            yield pdf.astype({n: "Int64" for n in whole})

    return paths.select("path").mapInPandas(typed, schema)


HEADER = "path string, flags long, page_size long, commit long, min_txid long, max_txid long, ts_ms long, pre_apply string, wal_offset long, wal_size long, wal_salt1 long, wal_salt2 long, node_id string, error string"


def _header(path: str) -> Iterator[tuple]:
    h = codec.decode_header(read(path, 0, HEADER_SIZE))
    h |= {"path": path, "pre_apply": f"{h['pre_apply']:016x}", "node_id": f"{h['node_id']:016x}", "error": None}
    yield tuple(h[f.split()[0]] for f in HEADER.split(", "))


def _headers_of(paths: DataFrame) -> DataFrame:
    return _mapped(paths, HEADER, _header)


def headers(spark: SparkSession, root: str) -> DataFrame:
    return _headers_of(files(spark, root).where(F.col("name").rlike(NAME)))


def _level(path: str) -> int | None:
    name = path.rsplit("/", 2)[-2]
    return int(name) if name.isdigit() else None


def _pages(path: str) -> Iterator[tuple]:
    h, pages, _ = codec.decode_file(read(path))
    for p in pages:
        yield path, _level(path), h["min_txid"], h["max_txid"], h["commit"], h["page_size"], h["ts_ms"], *p


PAGES = "path string, level int, min_txid long, max_txid long, commit long, page_size long, ts_ms long, pgno long, data binary, offset long, size long"


def pages(spark: SparkSession, root: str, plan: DataFrame | None = None) -> DataFrame:
    """A row for each page of each log file or, with a plan (level, min_txid, max_txid), of its files; the others are not opened."""
    m = manifest(spark, root)
    if plan is not None:
        m = m.join(plan.select("level", "min_txid", "max_txid"), ["level", "min_txid", "max_txid"], "left_semi")
    return _mapped(m, PAGES, _pages)


def pages_of(paths: DataFrame) -> DataFrame:
    """A row for each page of the log files at paths; works on streams of paths too."""
    return _mapped(paths, PAGES, _pages)


def _index(path: str) -> Iterator[tuple]:
    end = size_of(path)
    (size,) = struct.unpack(">Q", read(path, max(0, end - 24), 8))
    if size > end - HEADER_SIZE - 24:
        raise codec.FormatError("no page index")
    for pgno, (offset, n) in codec.decode_index(read(path, end - 24 - size)).items():
        yield path, pgno, offset, n, None


def page_index(paths: DataFrame) -> DataFrame:
    """path, pgno, offset, size of each frame, read from the files' tails; error if there is none to read."""
    return _mapped(paths, "path string, pgno long, offset long, size long, error string", _index)


def page_at(places: DataFrame, page_size: int) -> DataFrame:
    """The pages at places (path, offset, size), each read alone."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(p, *codec.decode_page(read(p, int(o), int(n)), page_size)) for p, o, n in pdf[["path", "offset", "size"]].itertuples(index=False)]
            yield pd.DataFrame(got, columns=["path", "pgno", "data"])

    return places.select("path", "offset", "size").mapInPandas(rows, "path string, pgno long, data binary")


def _verified(path: str) -> Iterator[tuple]:
    h, pages, _ = codec.decode_file(read(path))
    yield path, True, len(pages), h["commit"], None


def verify(paths: DataFrame) -> DataFrame:
    """path, ok, pages, commit, error: the whole of each file read and all its checksums compared."""
    return _mapped(paths, "path string, ok boolean, pages long, commit long, error string", _verified).withColumn("ok", F.coalesce("ok", F.lit(False)))


WAL = "path string, frame_n long, offset long, pgno long, commit long, salt1 long, salt2 long, data binary, error string"


def _wal(path: str) -> Iterator[tuple]:
    for f in codec.read_wal(read(path)):
        yield path, f["frame_n"], f["offset"], f["pgno"], f["commit"], f["salt1"], f["salt2"], f["data"], None


def wal_frames(spark: SparkSession, path: str) -> DataFrame:
    """The frames of write-ahead logs; a log whose header is not whole gives one row with the error alone."""
    return _mapped(spark.read.format("binaryFile").load(path), WAL, _wal)


def database_header(paths: DataFrame) -> DataFrame:
    def head(path: str) -> Iterator[tuple]:
        h = codec.db_header(read(path, 0, 100))
        yield path, h["page_size"], h["write_version"], h["read_version"], h["change_counter"], h["page_count"], None

    return _mapped(paths, "path string, page_size long, write_version long, read_version long, change_counter long, page_count long, error string", head)


def database_pages(paths: DataFrame, page_size: int) -> DataFrame:
    """path, pgno, data of database images, read a thousand pages at a time."""

    def rows(path: str) -> Iterator[tuple]:
        at = 0
        while b := read(path, at * page_size, MOST_PAGES * page_size):
            for i in range(0, len(b) - page_size + 1, page_size):
                yield path, at + i // page_size + 1, b[i : i + page_size]
            if len(b) < MOST_PAGES * page_size:
                return
            at += MOST_PAGES

    return _mapped(paths, "path string, pgno long, data binary", rows)


def parse_listing(lines: DataFrame, level: Column, value: str = "value") -> DataFrame:
    """A manifest from listing lines `name size ms` (ms: - if unknown); lines that are none are skipped."""
    line = F.col(value)
    pattern = "^([0-9a-f]{16}-[0-9a-f]{16}\\.ltx) ([0-9]{1,18}) (-|-?[0-9]{1,18})$"
    got = lines.where(line.rlike(pattern)).select(level.cast("int").alias("level"), *(F.regexp_extract(line, pattern, i).alias(c) for i, c in enumerate(("name", "size", "ms"), 1)))
    ms = F.when(F.col("ms") != "-", F.col("ms").cast("long"))
    out = got.select("level", name_part(F.col("name"), 1).alias("min_txid"), name_part(F.col("name"), 2).alias("max_txid"), F.col("size").cast("long").alias("size"), F.timestamp_millis(ms).alias("created_at"))
    return out.where((F.col("min_txid") > 0) & (F.col("min_txid") <= F.col("max_txid")) & F.col("level").between(0, SNAPSHOT_LEVEL))


def parse_stream(lines: DataFrame, value: str = "value") -> DataFrame:
    """kind, level, low, high, size of a stream's text lines: ltx level min max size, ping max, gap next, reset max; error for others."""
    part = lambda i: F.get(F.split(F.col(value), " "), i)
    h = "[0-9a-f]{16}"
    kind = F.when(F.col(value).rlike(f"^ltx [0-9] {h} {h} [0-9]{{1,18}}$|^(ping|gap|reset) {h}$"), part(0))
    is_file = kind == "ltx"
    return lines.select(
        F.coalesce(kind, F.lit("error")).alias("kind"),
        F.when(is_file, part(1).cast("int")).alias("level"),
        unhex16(F.when(is_file, part(2)).when(kind.isNotNull(), part(1))).alias("low"),
        unhex16(F.when(is_file, part(3)).when(kind.isNotNull(), part(1))).alias("high"),
        F.when(is_file, part(4).cast("long")).alias("size"),
    )
