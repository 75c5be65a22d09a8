"""The stream follower: order, holes, bridges, truncation, replays."""

import random

import pytest
from pagetide.streaming.follow import Follower, follow

SCHEMA = "txid long, pgno long, data double, commit long, seq long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def pages(f):
    return {r["pgno"]: r["data"] for r in f.state().collect()}


def test_follow(spark, tmp_path):
    src = tmp_path / "in"
    frame(spark, [(1, 1, 1.0, 2, 0), (2, 2, 2.0, 2, 1)]).coalesce(1).write.parquet(str(src))
    f = Follower(spark, str(tmp_path / "state"))
    run = lambda: follow(spark.readStream.schema(SCHEMA).parquet(str(src)), f, str(tmp_path / "ck")).awaitTermination()
    run()
    frame(spark, [(2, 2, 9.0, 2, 1), (3, 1, 3.0, 1, 2)]).coalesce(1).write.mode("append").parquet(str(src))
    run()
    assert f.position() == 3 and pages(f) == {1: 3.0}
    f(frame(spark, [(4, 1, 0.0, 1, 9)]), 1)  # applied before: skipped
    assert f.position() == 3


def test_holes_are_held_back(spark, tmp_path):
    f = Follower(spark, str(tmp_path))
    f(frame(spark, [(1, 1, 1.0, 9, 0), (3, 3, 3.0, 9, 2), (5, 5, 5.0, 9, 4)]), 0)
    assert f.position() == 1 and pages(f) == {1: 1.0} and f.events == [(0, "gap", 3), (0, "applied", 1)]
    f(frame(spark, [(2, 1, 2.0, 9, 1)]), 1)
    assert f.position() == 3 and pages(f) == {1: 2.0, 3: 3.0}
    f(frame(spark, [(4, 3, 4.0, 9, 3)]), 2)
    assert f.position() == 5 and pages(f) == {1: 2.0, 3: 4.0, 5: 5.0}
    f(frame(spark, [(2, 1, 7.0, 9, 1)]), 3)  # a late repeat
    assert pages(f)[1] == 2.0 and f.events[-1] == (3, "idle", 5)


def test_split_transactions_wait_for_their_rows(spark, tmp_path):
    f = Follower(spark, str(tmp_path))
    part = lambda rows: spark.createDataFrame(rows, SCHEMA + ", n_rows long")
    f(part([(1, 1, 1.0, 0, 0, 2)]), 0)
    assert f.position() == 0 and f.state() is None
    f(part([(1, 2, 2.0, 2, 1, 2), (2, 1, 3.0, 2, 2, 1)]), 1)
    assert f.position() == 2 and pages(f) == {1: 3.0, 2: 2.0}


def test_bridges_are_asked_until_the_hole_is_closed(spark, tmp_path):
    files = {3: [(3, 1, 30.0, 9, 0), (3, 2, 31.0, 9, 0)], 6: [(6, 2, 60.0, 9, 0)]}

    def on_gap(position, nxt):
        asked.append((position, nxt))
        best = [m for m in files if m > position]
        return frame(spark, files[min(best)]) if best and position >= 1 else None

    asked = []
    f = Follower(spark, str(tmp_path), on_gap)
    f(frame(spark, [(1, 1, 1.0, 9, 0), (7, 3, 70.0, 9, 0), (6, 4, 99.0, 9, 0)]), 0)
    assert asked == [(1, 6), (3, 6)]
    assert f.position() == 7 and pages(f) == {1: 30.0, 2: 60.0, 3: 70.0}


def test_truncated_pages_do_not_come_back(spark, tmp_path):
    f = Follower(spark, str(tmp_path))
    f(frame(spark, [(1, p, float(p), 5 if p == 5 else 0, p) for p in range(1, 6)]), 0)
    f(frame(spark, [(2, 1, 10.0, 2, 0), (3, 4, 40.0, 4, 1)]), 1)
    assert pages(f) == {1: 10.0, 2: 2.0, 4: 40.0}


@pytest.mark.parametrize("seed", [0, 1])
def test_against_plain_application(spark, tmp_path, seed):
    rng = random.Random(seed)
    log, state, size = [], {}, 4
    for t in range(1, 41):
        size = max(1, size + rng.choice([-3, -1, 0, 0, 1, 2]))
        touched = rng.sample(range(1, size + 1), rng.randint(1, min(3, size)))
        rows = [(t, p, float(100 * t + i), size if i == len(touched) - 1 else 0, i) for i, p in enumerate(touched)]
        state = {p: d for p, d in state.items() if p <= size} | {r[1]: r[2] for r in rows}
        log.append(rows)
    rng.shuffle(log)
    f = Follower(spark, str(tmp_path), fanout=2)
    for i in range(0, 40, 6):
        f(frame(spark, [r for rows in log[i : i + 6] for r in rows]), i)
    assert f.position() == 40 and pages(f) == state
    assert len(f.pointer()["runs"]) <= 4


def test_follow_bucket(spark, tmp_path):
    from pagetide.plans import maintain
    from pagetide.sinks import log_files as sink
    from pagetide.sources.store import Store
    from pagetide.streaming.bucket import follow_bucket

    from .test_files import COLS, transactions

    root = str(tmp_path / "bucket")
    rows, states = transactions(14, seed=5)
    put = lambda low, high: sink.write_files(spark.createDataFrame([r for r in rows if low <= r[1] <= high], COLS), root)

    def run():
        follower, query = follow_bucket(spark, root, str(tmp_path / "state"), str(tmp_path / "ck"))
        query.awaitTermination()
        return follower

    put(1, 4)
    f = run()
    assert f.position() == 4 and pages(f) == states[3]
    put(5, 9)
    maintain.compact_level(spark, root, 1)
    Store(root).delete(*(f"0/{t:016x}-{t:016x}.ltx" for t in range(5, 9)))
    f = run()  # 5 to 8 are gone from level 0: level 1 bridges them
    assert f.position() == 9 and pages(f) == states[8] and f.events[0][1] == "bridged"
    put(10, 14)
    maintain.snapshot(spark, root)
    Store(root).delete(*(f"0/{t:016x}-{t:016x}.ltx" for t in range(9, 14)), "1")
    f = run()
    assert f.position() == 14 and pages(f) == states[13]
