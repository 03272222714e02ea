"""Started streams over files, one a batch, with late, repeated and out-of-order rows."""

import random

import pytest

from quillstack.sources.store import Store
from quillstack.streaming import state as S

EVENTS = "user long, ts timestamp, id long, value double, hidden boolean"


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, S.ROCKSDB)
    yield spark
    spark.conf.set(key, before)


def _stream(spark, folder, schema, batches):
    """A stream that reads one batch after the other."""
    for i, rows in enumerate(batches):
        place = folder / f"b{i:03d}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(place))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/*")


def _run(df, tmp_path, mode):
    out = []
    query = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).foreachBatch(lambda b, i: out.extend(tuple(r) for r in b.collect())).start()
    try:
        assert query.awaitTermination(150)
    finally:
        query.stop()
    return out


def _at(seconds):
    from datetime import UTC, datetime

    return datetime.fromtimestamp(1_700_000_000 + seconds, UTC).replace(tzinfo=None)


def test_saves_after_a_pause_and_at_a_flush(rocksdb, tmp_path):
    batches = [
        [(1, _at(0), 1, 0.1, False), (1, _at(3), 2, 0.2, False), (2, _at(1), 3, 0.5, False)],
        [(1, _at(2), 4, 0.15, False), (1, _at(3), 5, 0.25, False), (2, _at(2), 6, 0.6, True)],  # out of order, a tie, and a flush
        [(1, _at(30), 7, 0.9, False), (3, _at(31), 8, 0.3, None)],  # a pause in the events themselves
        [(3, _at(33), 9, 0.4, False), (1, _at(1), 10, 0.0, False)],  # a whole pause behind
        [(9, _at(200), 11, 1.0, True)],  # moves the watermark on
    ]
    df = S.saves(_stream(rocksdb, tmp_path / "in", EVENTS, batches), "user", "ts", "id", "value", "hidden", 10_000, "5 seconds")
    got = sorted((u, (at - 1_700_000_000_000) // 1000, id_, v, n) for u, at, id_, v, n in _run(df, tmp_path, "append"))
    assert got == [(1, 3, 5, 0.25, 4), (1, 30, 7, 0.9, 1), (2, 2, 6, 0.6, 2), (3, 33, 9, 0.4, 2), (9, 200, 11, 1.0, 1)]


SAMPLES = "doc long, pass long, ord long, kind string, predicted double, actual double, last boolean"


def _guard(rows, tolerance=2.0, size=5):
    """All rows of a run in order, pass by pass."""
    gone, out = set(), []
    for p in sorted({r[1] for r in rows}):
        own = [r for r in sorted(rows, key=lambda r: r[2]) if r[1] == p and r[3] in ("paragraph", "heading") and r[3] not in gone][:size]
        worst = {}
        for _, _, _, kind, x, y, _ in own:
            if abs(y - x) > tolerance:
                worst[kind] = max(worst.get(kind, 0.0), abs(y - x))
        out += [(rows[0][0], p, k, v) for k, v in worst.items()]
        gone |= set(worst)
    return out


def test_downgrades_never_go_back(rocksdb, tmp_path):
    rng = random.Random(2)
    runs, batches = {}, [[] for _ in range(4)]
    for doc in range(12):
        for p in range(4):
            rows = [(doc, p, i, rng.choice(("paragraph", "heading", "figure")), 10.0, 10.0 + rng.choice((0.0, 1.0, 2.0, 3.5, -4.25)) * (rng.random() < 0.3), False) for i in range(9)]
            rows[-1] = (*rows[-1][:6], True)
            runs.setdefault(doc, []).extend(rows)
            shuffled = rows[:5]
            rng.shuffle(shuffled)
            batches[p] += shuffled + rows[5:] + ([(doc, p - 2, 0, "heading", 0.0, 99.0, False)] if p > 1 else [])
    df = S.downgrades(_stream(rocksdb, tmp_path / "in", SAMPLES, batches), "doc", 2.0)
    want = [r for rows in runs.values() for r in _guard(rows)]
    assert want and sorted(_run(df, tmp_path, "update")) == sorted(want)
    assert all(len({k for d, _, k, _ in want if d == doc}) == sum(d == doc for d, *_ in want) for doc in runs)


def test_newest_rows_of_a_stream(rocksdb, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(20), _at(rng.randrange(500)), i, float(i), False) for i in range(300)]
    batches = [rows[:100], rows[60:200], rows[200:]]
    store = Store(rocksdb, str(tmp_path / "store"))
    sink = S.newest_rows(store, "positions", ["user"], ["ts", "id"], buckets=4)
    assert S.kept_rows(store, "positions") is None
    df = _stream(rocksdb, tmp_path / "in", EVENTS, batches)
    query = df.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).foreachBatch(sink).start()
    assert query.awaitTermination(150)
    want = {}
    for r in rows:
        want[r[0]] = max(want.get(r[0], r), r, key=lambda r: r[1:3])
    kept = lambda: sorted(tuple(r) for r in S.kept_rows(store, "positions").collect())
    assert kept() == sorted(want.values())
    state = store.state()
    sink(rocksdb.createDataFrame([(1, _at(999), 999, 9.0, False)], EVENTS), 1)  # a batch that was committed before
    assert store.state() == state and store.mark("positions") == 2
    sink(rocksdb.createDataFrame([(1, _at(999), 999, 9.0, False)], EVENTS), 3)
    assert kept() == sorted((want | {1: (1, _at(999), 999, 9.0, False)}).values())
    assert sum(state[1][k] != v for k, v in store.state()[1].items()) == 1
