"""Scalar functions on ids, ranges, sizes and errors, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the log format.
HEADER_SIZE, TRAILER_SIZE, PAGE_HEADER_SIZE = 100, 16, 6
WAL_HEADER_SIZE, WAL_FRAME_HEADER_SIZE = 32, 24
SNAPSHOT_LEVEL = 9
NAME = "^([0-9a-f]{16})-([0-9a-f]{16})\\.ltx$"
TRANSIENT = ["unavailable", "io"]


def hex16(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def unhex16(s: Column) -> Column:
    """Exactly 16 hex digits of either case that fit a signed long; else null."""
    return F.when(s.rlike("^[0-7][0-9a-fA-F]{15}$"), F.conv(s, 16, 10).cast("long"))


def file_name(low: Column, high: Column) -> Column:
    return F.concat(hex16(low), F.lit("-"), hex16(high), F.lit(".ltx"))


def name_part(name: Column, i: int) -> Column:
    return unhex16(F.regexp_extract(name, NAME, i))


def is_contiguous(before: Column, low: Column, high: Column) -> Column:
    return (low <= before + 1) & (high > before)


def lock_page(page_size: Column) -> Column:
    return F.floor(F.lit(1 << 30) / page_size) + 1


def valid_page_size(page_size: Column) -> Column:
    return page_size.between(512, 65536) & (F.bit_count(page_size) == 1)


def wal_size(page_size: Column, frames: Column) -> Column:
    return F.lit(WAL_HEADER_SIZE) + (page_size + WAL_FRAME_HEADER_SIZE) * frames


def backoff_ms(attempt: Column, first: int = 500, most: int = 60_000) -> Column:
    """Doubling, without jitter."""
    return F.least(F.lit(first) * F.pow(F.lit(2.0), attempt), F.lit(float(most))).cast("long")


def is_transient(kind: Column) -> Column:
    return F.coalesce(kind.isin(TRANSIENT), F.lit(False))


def listing_line(name: Column, size: Column, created_ms: Column) -> Column:
    return F.concat_ws(" ", name, size.cast("string"), F.coalesce(created_ms.cast("string"), F.lit("-")))


def positions(low: Column, high: Column, pre_apply: Column, post_apply: Column) -> Column:
    """What a file takes a database from and to: (txid, checksum) before and after."""
    return F.struct(F.struct((low - 1).alias("txid"), pre_apply.alias("checksum")).alias("before"), F.struct(high.alias("txid"), post_apply.alias("checksum")).alias("after"))


def valid_flags(flags: Column) -> Column:
    return flags.bitwiseAND(~2) == 0


def visible_ascii(s: Column) -> Column:
    """What a token or writer id may consist of."""
    return F.coalesce(s.rlike("^[!-~]+$"), F.lit(False))
