"""Sinks of a bucket: log files encoded from a DataFrame of pages, database images, deletion.

Pages are compressed and checksummed where they lie; one task a file then streams its sorted frames, so memory is a batch of
pages and the index, however large the file. A file's name is a function of its transactions and it appears whole, so a
retried task replaces it with the same.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.columns import file_name
from ..sources.store import Store

_FILE = ["level", "min_txid", "max_txid"]
_OPTIONAL = ["ts_ms", "pre_apply", "post_apply"]
WRITTEN = "level int, min_txid long, max_txid long, commit long, pages long, size long, name string"


def _frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        frame, crc = [], []
        for data in pdf["data"]:
            frame.append(codec.compress_page(bytes(data)))
        size = [len(d) for d in pdf["data"]]
        if len(set(size)) == 1:
            crc = codec.crc64_rows(np.frombuffer(b"".join(bytes(d) for d in pdf["data"]), np.uint8).reshape(len(pdf), -1)).tolist()
        else:
            crc = [codec.crc64(bytes(d)) for d in pdf["data"]]
        yield pdf.drop(columns="data").assign(frame=frame, crc=np.array(crc, np.uint64).view(np.int64), page_size=size)


def write_files(pages: DataFrame, root: str, flags: int = codec.NO_CHECKSUM) -> DataFrame:
    """Writes a log file for each (level, min_txid, max_txid) of pages (these, commit, pgno, data; ts_ms, pre_apply, post_apply if there are); gives a row for each.

    Rows with a null pgno make a file without pages, of page_size if that is a column. A bad page, a snapshot with a hole or
    pages of unequal size fail the job and leave no file.
    """
    cols = [(F.col(c).cast("long") if c in pages.columns else F.lit(None)).cast("string").alias(c) for c in _OPTIONAL]
    own = F.col("page_size").cast("long") if "page_size" in pages.columns else F.lit(None).cast("long")
    p = pages.select(F.col("level").cast("int").alias("level"), F.col("min_txid").cast("long").alias("min_txid"), F.col("max_txid").cast("long").alias("max_txid"), F.col("commit").cast("long").alias("commit"), *cols, own.alias("own_size"), F.col("pgno").cast("long").alias("pgno"), "data")
    head = "level int, min_txid long, max_txid long, commit long, ts_ms string, pre_apply string, post_apply string, own_size long, pgno long"
    some = p.where("pgno is not null").mapInPandas(_frames, f"{head}, frame binary, crc long, page_size long")
    none = p.where("pgno is null").select("*", F.lit(None).cast("binary").alias("frame"), F.lit(0).cast("long").alias("crc"), F.lit(None).cast("long").alias("page_size")).drop("data")
    dealt = some.unionByName(none).repartition(*_FILE).sortWithinPartitions(*_FILE, F.col("pgno").asc_nulls_first())
    rows = dealt.mapInPandas(_Writer(root, flags), WRITTEN).collect()  # one small row a file
    return pages.sparkSession.createDataFrame(rows, WRITTEN)


class _Writer:
    def __init__(self, root: str, flags: int):
        self.root, self.flags = root, flags

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, key, rows = Store(self.root), None, None
        out: list[tuple] = []

        def parts() -> Iterator[tuple[tuple, Iterator]]:
            for pdf in batches:
                yield from pdf.itertuples(index=False)

        it = parts()
        row = next(it, None)
        while row is not None:
            key = (row.level, row.min_txid, row.max_txid)
            name = f"{row.level}/{row.min_txid:016x}-{row.max_txid:016x}.ltx"
            with store.writing(name) as f:
                writer, rows = None, 0
                size = next(int(x) for x in (row.page_size, row.own_size, 4096) if not pd.isna(x))
                number = lambda x: 0 if pd.isna(x) else int(x)
                post = None if pd.isna(row.post_apply) else int(row.post_apply) & codec.M64
                commit = int(row.commit)
                h = {"flags": self.flags, "page_size": size, "commit": commit, "min_txid": int(key[1]), "max_txid": int(key[2]), "ts_ms": number(row.ts_ms), "pre_apply": number(row.pre_apply) & codec.M64}
                writer = codec.FileWriter(f, h)
                while row is not None and (row.level, row.min_txid, row.max_txid) == key:
                    if not pd.isna(row.pgno):
                        writer.page(int(row.pgno), row.frame, int(row.crc) & codec.M64, int(row.page_size))
                        rows += 1
                    row = next(it, None)
                total = writer.finish(post)
            out.append((*map(int, key), commit, rows, total, name))
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in WRITTEN.split(", ")])


def delete_files(files: DataFrame, root: str) -> int:
    """Deletes the files (level, min_txid, max_txid) of a bucket; one that is gone already counts as deleted. Names stream through the driver."""
    store, n = Store(root), 0
    for r in files.select(F.concat(F.col("level").cast("string"), F.lit("/"), file_name(F.col("min_txid"), F.col("max_txid"))).alias("name")).toLocalIterator():
        store.delete(r["name"])
        n += 1
    return n


def delete_all(root: str) -> None:
    Store(root).delete("")


def present(page: bytes, counter: int) -> bytes:
    """Page 1 as a reader without the log must find it: rollback journal, and a change counter that no cache knows."""
    return page[:18] + b"\x01\x01" + page[20:24] + struct.pack(">I", counter & codec.M32) + page[28:] if len(page) >= 28 else page


class _Image:
    def __init__(self, root: str, commit: int, page_size: int, per_slice: int, counter: int | None):
        self.root, self.commit, self.page_size, self.per_slice, self.counter = root, commit, page_size, per_slice, counter
        self.lock = (1 << 30) // page_size + 1

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, out = Store(self.root), []
        it = (r for pdf in batches for r in pdf.itertuples(index=False))
        row = next(it, None)
        while row is not None:
            part = row.slice
            low, high = part * self.per_slice + 1, min((part + 1) * self.per_slice, self.commit)
            with store.writing(f"image-{part:010d}.db") as f:
                for pgno in range(low, high + 1):
                    if pgno == self.lock:
                        f.write(bytes(self.page_size))
                        if row is not None and row.slice == part and row.pgno == pgno:
                            row = next(it, None)
                        continue
                    if row is None or row.slice != part or row.pgno != pgno or len(row.data) != self.page_size:
                        raise codec.FormatError(f"image lacks page {pgno}")
                    f.write(present(row.data, self.counter) if pgno == 1 and self.counter is not None else row.data)
                    row = next(it, None)
            if row is not None and row.slice == part:
                raise codec.FormatError(f"page {row.pgno} after the last")
            out.append((part, high - low + 1))
        if out:
            yield pd.DataFrame(out, columns=["slice", "pages"])


def write_image(pages: DataFrame, root: str, commit: int, page_size: int, per_slice: int = 1 << 18, counter: int | None = None) -> int:
    """Writes pages (pgno, data) 1 to commit in order, the lock page as zeros, as slices of per_slice pages whose concatenation is the image.

    A page that is missing, or one beyond commit, fails the job. counter: page 1 is made presentable with it. How many pages were written.
    """
    p = pages.select(F.floor((F.col("pgno") - 1) / per_slice).cast("long").alias("slice"), F.col("pgno").cast("long").alias("pgno"), "data")
    done = p.repartition("slice").sortWithinPartitions("slice", "pgno").mapInPandas(_Image(root, commit, page_size, per_slice, counter), "slice long, pages long")
    n = done.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    if n != commit:
        raise codec.FormatError(f"image has {n} pages, not {commit}")
    return n
