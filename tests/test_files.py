"""Files written from DataFrames and read back: codec, ranged sources, sinks, compaction, retention, images, logs."""

import random
import sqlite3
import struct

import pytest
from pagetide.functions import codec
from pagetide.plans import maintain, push, restore
from pagetide.sinks import log_files as sink
from pagetide.sources import log_files
from pagetide.sources.store import Store
from pyspark.sql import functions as F

PS = 512
COLS = "level int, min_txid long, max_txid long, commit long, ts_ms long, pgno long, data binary"


def page(*key):
    return bytes([sum(key) % 251]) * (PS - 8) + struct.pack(">Q", hash(key) & codec.M32)


def transactions(n, seed=0, size=9):
    """Rows of n transactions after a first that holds all pages, and the state after each."""
    rng, rows, states, state = random.Random(seed), [], [], {}
    for t in range(1, n + 1):
        size = max(3, size + rng.choice([-2, 0, 0, 1, 2])) if t > 1 else size
        touched = range(1, size + 1) if t == 1 else sorted({*rng.sample(range(1, size + 1), 3), *(p for p in range(1, size + 1) if p not in state)})
        new = {p: page(t, p) for p in touched}
        state = {p: d for p, d in state.items() if p <= size} | new
        rows += [(0, t, t, size, t * 1000, p, d) for p, d in new.items()]
        states.append(dict(state))
    return rows, states


def by_page(df):
    return {r["pgno"]: bytes(r["data"]) for r in df.collect()}


def test_crc_pieces():
    rng = random.Random(1)
    data = rng.randbytes(70_001)
    assert codec.crc64(b"123456789") == 0xB90956C775A41001
    for cut in (0, 1, 9, 16_384, 40_000):
        assert codec.crc64(data[cut:], codec.crc64(data[:cut])) == codec.crc64(data)
        assert codec.crc64_joined(codec.crc64(data[:cut]), codec.crc64(data[cut:]), len(data) - cut) == codec.crc64(data)


def test_lz4_frames():
    for data in (b"", b"a" * 5000, random.Random(2).randbytes(70_000), b"x" * 200_000):
        frame = codec.compress_page(data)
        assert frame[4:6] == b"\x64\x40" and codec.decompress_page(frame, len(data)) == data
        for broken in (frame[:-1], frame + b"\0", frame[:-3] + b"\1\2\3"):
            with pytest.raises(codec.FormatError):
                codec.decompress_page(broken, len(data))


def test_round_trip_and_broken_files(spark, tmp_path):
    root = str(tmp_path)
    rows, _ = transactions(5)
    written = sink.write_files(spark.createDataFrame(rows, COLS).repartition(3), root)
    assert sorted(r["min_txid"] for r in written.collect()) == [1, 2, 3, 4, 5]
    m = log_files.manifest(spark, root, exact_time=True)
    assert m.count() == 5 and m.agg(F.max(F.unix_millis("created_at"))).first()[0] == 5000
    back = log_files.pages(spark, root).select("level", "min_txid", "max_txid", "commit", "ts_ms", "pgno", "data")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    only = log_files.pages(spark, root, spark.createDataFrame([(0, 2, 2)], "level int, min_txid long, max_txid long"))
    assert {r["min_txid"] for r in only.collect()} == {2}
    places = log_files.page_index(m)
    alone = log_files.page_at(places.where("pgno = 1 and error is null"), PS)
    assert {bytes(r["data"]) for r in alone.collect()} == {d for *_, p, d in rows if p == 1}
    name = f"0/{3:016x}-{3:016x}.ltx"
    whole = Store(root).get(name)
    for bad in (whole[:150], whole[:200] + bytes([whole[200] ^ 1]) + whole[201:], whole[:-1] + bytes([whole[-1] ^ 1]), b"LTX1" * 40):
        Store(root).put(name, bad)
        got = {r["path"].rsplit("/")[-1][:16]: (r["ok"], r["error"]) for r in log_files.verify(log_files.manifest(spark, root)).collect()}
        assert [ok for ok, _ in got.values()].count(True) == 4 and not got[f"{3:016x}"][0] and got[f"{3:016x}"][1]


def test_bad_pages_leave_no_file(spark, tmp_path):
    rows, _ = transactions(1)
    for bad in ([rows[0][:5] + (1, b"short")], [r for r in rows if r[5] != 2], [*rows, (0, 1, 1, 9, 0, 99, page(1))]):
        with pytest.raises(Exception, match="page|lacks"):
            sink.write_files(spark.createDataFrame(bad, COLS), str(tmp_path))
    assert not [f for f in tmp_path.rglob("*") if f.is_file()]


def test_snapshot_checksum_and_empty_file(spark, tmp_path):
    rows, _ = transactions(1)
    sink.write_files(spark.createDataFrame(rows, COLS), str(tmp_path), flags=0)
    b = Store(str(tmp_path)).get(f"0/{1:016x}-{1:016x}.ltx")
    want = codec.FLAG
    for r in rows:
        want = codec.FLAG | (want ^ codec.page_checksum(r[5], r[6]))
    assert codec.decode_file(b)[2] == want
    none = spark.createDataFrame([(0, 2, 2, 0, 0, None, None)], COLS).withColumn("page_size", F.lit(PS))
    sink.write_files(none, str(tmp_path))
    assert codec.decode_file(Store(str(tmp_path)).get(f"0/{2:016x}-{2:016x}.ltx"))[1] == []


@pytest.mark.parametrize("seed", [0, 3])
def test_compaction_snapshot_image_and_retention(spark, tmp_path, seed):
    root = str(tmp_path / "bucket")
    rows, states = transactions(12, seed)
    sink.write_files(spark.createDataFrame([r for r in rows if r[1] <= 8], COLS), root)
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    report = maintain.maintain(spark, root, now, maintain.Options(intervals={1: 0, 2: 0}, snapshot_interval=10**9, snapshot_retention=10**10, l0_grace=0))
    assert report.compacted == [1, 2] and report.snapshot == 8 and report.deleted == 7
    left = {(r["level"], r["min_txid"], r["max_txid"]) for r in log_files.manifest(spark, root).collect()}
    assert left == {(0, 8, 8), (1, 1, 8), (2, 1, 8), (9, 1, 8)}
    sink.write_files(spark.createDataFrame([r for r in rows if r[1] > 8], COLS), root)
    m = log_files.manifest(spark, root)
    for t in (8, 10, 12):
        plan = restore.plan_frame(m, t)
        assert by_page(restore.restore(m, log_files.pages(spark, root, plan), t)) == states[t - 1]
    assert maintain.compact_level(spark, root, 1).first()["min_txid"] == 9
    assert maintain.snapshot(spark, root) == 12
    pages = log_files.pages(spark, root, spark.createDataFrame([(9, 1, 12)], "level int, min_txid long, max_txid long"))
    size = max(states[11])
    assert sink.write_image(pages, str(tmp_path / "image"), size, PS, per_slice=4) == size
    image = b"".join(Store(str(tmp_path / "image")).get(n) for n, _ in Store(str(tmp_path / "image")).list())
    assert image == b"".join(states[11][p] for p in range(1, size + 1))
    with pytest.raises(Exception, match="lacks"):
        sink.write_image(pages.where("pgno <> 2"), str(tmp_path / "none"), size, PS)
    again = maintain.maintain(spark, root, now, maintain.Options(intervals={}, snapshot_interval=10**12, snapshot_retention=0, l0_grace=0))
    kept = {(r["level"], r["min_txid"], r["max_txid"]) for r in log_files.manifest(spark, root).collect()}
    assert again.deleted == 5 and kept == {(0, 12, 12), (1, 1, 8), (1, 9, 12), (2, 1, 8), (9, 1, 12)}  # what ends at the floor stays
    sink.delete_all(root)
    assert not Store(root).list("0")


def test_compaction_checks_its_inputs(spark, tmp_path):
    rows, _ = transactions(4)
    sink.write_files(spark.createDataFrame([r for r in rows if r[1] != 3], COLS), str(tmp_path))
    with pytest.raises(codec.FormatError):
        maintain.compact_level(spark, str(tmp_path), 1)
    assert maintain.compact_level(spark, str(tmp_path), 2) is None


def test_log_of_a_database(spark, tmp_path):
    path = str(tmp_path / "a.db")
    db = sqlite3.connect(path, isolation_level=None)
    db.execute("PRAGMA page_size = 4096")
    db.execute("PRAGMA journal_mode = WAL")
    db.execute("PRAGMA wal_autocheckpoint = 0")
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, v TEXT)")
    db.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    for i in range(300):
        db.execute("INSERT INTO t(v) VALUES (?)", (f"row-{i:06d}" * 9,))
    root = str(tmp_path / "bucket")
    push.push_snapshot(spark, path, path + "-wal", root, 7)
    pages = log_files.pages(spark, root)
    n = pages.first()["commit"]
    sink.write_image(pages, str(tmp_path / "image"), n, 4096, counter=5)
    got = sqlite3.connect(str(tmp_path / "image" / "image-0000000000.db"))
    assert got.execute("PRAGMA integrity_check").fetchone() == ("ok",)
    assert got.execute("SELECT id, v FROM t ORDER BY id").fetchall() == db.execute("SELECT id, v FROM t ORDER BY id").fetchall()
    one = push.push(spark, path + "-wal", root, 8).first()
    frames = log_files.wal_frames(spark, path + "-wal")
    assert one["min_txid"] == 8 and one["pages"] == frames.select("pgno").distinct().count()
    (tmp_path / "short-wal").write_bytes(b"7" * 10)
    assert log_files.wal_frames(spark, str(tmp_path / "short-wal")).first()["error"] == "short wal header"


def test_listing_and_stream_lines(spark):
    name = f"{1:016x}-{255:016x}.ltx"
    lines = [f"{name} 120 1720000000123", f"{name} 5 -", "stray.tmp 1 -", f"{name} x -", f"{255:016x}-{1:016x}.ltx 1 -"]
    got = log_files.parse_listing(spark.createDataFrame([(x,) for x in lines], "value string"), F.lit(2)).collect()
    assert sorted((r["level"], r["min_txid"], r["max_txid"], r["size"]) for r in got) == [(2, 1, 255, 5), (2, 1, 255, 120)]
    lines = [f"ltx 0 {3:016x} {4:016x} 99", f"ping {9:016x}", f"gap {10:016x}", f"reset {2:016x}", "ltx 0 3 4 99", "hello"]
    got = log_files.parse_stream(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r["kind"] for r in got] == ["ltx", "ping", "gap", "reset", "error", "error"]
    assert (got[0]["low"], got[0]["high"], got[0]["size"], got[1]["low"]) == (3, 4, 99, 9)


def test_sync_plan(spark):
    def plan(files, position):
        return restore.sync_plan(spark.createDataFrame(files, "level int, min_txid long, max_txid long"), position)

    assert plan([], 3) == ([], "empty") and plan([(0, 1, 2)], 3) == ([], "diverged") and plan([(0, 3, 3)], 3) == ([], "current")
    assert plan([(0, 4, 4), (0, 5, 5)], 3) == ([(0, 4, 4), (0, 5, 5)], "applied")
    assert plan([(0, 9, 9), (1, 3, 6), (1, 7, 8)], 4) == ([(1, 3, 6), (1, 7, 8), (0, 9, 9)], "applied")
    assert plan([(0, 9, 9), (2, 1, 7), (1, 8, 8)], 4) == ([(2, 1, 7), (1, 8, 8), (0, 9, 9)], "applied")
    assert plan([(9, 1, 9)], 4) == ([(9, 1, 9)], "snapshot") and plan([(0, 9, 9)], 4) == ([], "stuck")
