"""The binary format, sources, restore planning, leases and stream following."""

import os
import random
import sqlite3

import pytest
from pagetide.functions import codec
from pagetide.operators.fence import lease_fold
from pagetide.plans import restore
from pagetide.sources import log_files


def test_fixed_values():
    assert codec.crc64(b"123456789") == 0xB90956C775A41001
    assert codec.get_uvarint(codec.put_uvarint(2**64 - 1), 0) == (2**64 - 1, 10)
    with pytest.raises(codec.FormatError):
        codec.get_uvarint(b"\xff" * 11, 0)


def header(**k):
    return {"flags": codec.NO_CHECKSUM, "page_size": 512, "commit": 3, "min_txid": 1, "max_txid": 1, **k}


def test_file_round_trip():
    pages = [(i, os.urandom(256) + bytes(256)) for i in (1, 2, 3)]
    b = codec.encode_file(header(), pages, 7)
    h, got, post = codec.decode_file(b)
    assert (h["commit"], [(p, d) for p, d, _, _ in got], post) == (3, pages, 7)
    offset, size = got[1][2:]
    assert codec.decode_page(b[offset : offset + size], 512) == pages[1]
    with pytest.raises(codec.FormatError):
        codec.decode_file(b[:-1] + bytes([b[-1] ^ 1]))
    for bad in ([pages[0], pages[2]], pages[::-1], [(4, pages[0][1])]):
        with pytest.raises(codec.FormatError):
            codec.encode_file(header(), bad)


def test_wal_of_a_real_database(tmp_path):
    path = str(tmp_path / "a.db")
    con = sqlite3.connect(path)
    con.execute("PRAGMA journal_mode=WAL")
    con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)")
    for i in range(20):
        con.execute("INSERT INTO t VALUES (?, ?)", (i, "x" * 300))
        con.commit()
    b = open(path + "-wal", "rb").read()
    frames = list(codec.read_wal(b))
    assert len(frames) == (len(b) - 32) // 4120 and frames[-1]["commit"] > 0
    at = frames[5]["offset"]
    rest = list(codec.read_wal(b, at, (frames[4]["salt1"], frames[4]["salt2"])))
    assert rest == frames[5:]
    broken = bytearray(b)
    broken[frames[9]["offset"] + 100] ^= 1
    assert len(list(codec.read_wal(bytes(broken)))) == 9
    assert codec.db_header(frames[0]["data"] if frames[0]["pgno"] == 1 else open(path, "rb").read())["page_size"] == 4096
    con.close()


def test_sources_and_restore(spark, tmp_path):
    state = {}
    for level, low, high, pgs in ((9, 1, 4, (1, 2, 3)), (0, 5, 5, (2,)), (0, 6, 6, (3,)), (1, 5, 6, (2, 3))):
        d = tmp_path / "ltx" / str(level)
        d.mkdir(parents=True, exist_ok=True)
        pages = [(p, bytes([high, p]) * 256) for p in pgs]
        (d / f"{low:016x}-{high:016x}.ltx").write_bytes(codec.encode_file(header(min_txid=low, max_txid=high), pages))
        state |= dict(pages)
    (tmp_path / "ltx" / "0" / "stray.tmp").write_bytes(b"")
    root = str(tmp_path / "ltx")
    m = log_files.manifest(spark, root)
    assert m.count() == 4 and log_files.headers(spark, root).where("error is null").count() == 4
    # both files of level 0 and the file of level 1 give the same pages at their newest
    assert restore.restore_plan(m) == [(1, 4, 9), (5, 6, 1)]
    got = restore.restore(m, log_files.pages(spark, root)).collect()
    assert [(r["pgno"], bytes(r["data"])) for r in sorted(got)][0] == (1, state[1])
    assert restore.restore_plan(m, 5) == [(1, 4, 9), (5, 5, 0)]


def test_greedy_against_plain_search():
    rng = random.Random(1)
    for _ in range(2000):
        files = sorted({(a, a + rng.randint(0, 5), rng.randint(0, 8)) for a in (rng.randint(1, 20) for _ in range(rng.randint(0, 8)))})
        target = rng.choice([0, rng.randint(1, 20)])
        ok = [f for f in files if not target or f[1] <= target]
        cur, plan = 0, []
        while True:
            c = [f for f in ok if f[0] <= cur + 1 and f[1] > cur]
            if not c:
                break
            plan.append(max(c, key=lambda f: (f[1], -f[0], f[2])))
            cur = plan[-1][1]
        try:
            got = restore.greedy(None, ok, target)
        except restore.TxNotAvailable:
            assert not plan or (target and cur != target)
        except restore.LogGap:
            assert any(f[0] > cur + 1 for f in ok)
        else:
            assert got == plan


def test_lease_fold():
    offers = [("a", False, 0.0, True), ("b", False, 1.0, True), ("b", True, 2.0, True), ("a", False, 3.0, True), ("a", False, 200.0, False), ("a", False, 201.0, True)]
    assert [x[0] for x in lease_fold(offers, None, None, 100.0)] == ["granted", "refused", "granted", "refused", "rejected", "granted"]
