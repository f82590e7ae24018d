"""Replayable logs and phase machines as streams, against batch results and a brute-force clock."""

import random

import pytest
from pyspark.sql import functions as F

from trailmesh.operators import trace
from trailmesh.sources import chunksource
from trailmesh.streaming import log_source, phases

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "t")
    rows = spark.range(1, 5001).select(F.col("id").alias("event"), (F.col("id") * 7 % 4).cast("int").alias("kind"), (F.col("id") % 97).alias("id")).persist()
    chunksource.write_chunked(rows, path, "event", 700)
    return rows, path


def run(spark, path, folder, start=0, most=900, batches=None, fail_at=None):
    """Counters after every batch: (last event, settled, examined, improved); stops after ``batches``, or fails in one."""
    seen = []

    def each(df, n):
        r = df.first()
        if fail_at is not None and n == fail_at:
            raise RuntimeError("lost")
        seen.append((r["last"], r["settled"], r["examined"], r["improved"]))
        if batches is not None and len(seen) >= batches:
            raise StopIteration

    counted = log_source.log_stream(spark, path, f"{folder}/progress", start, most).groupBy().agg(F.max("event").alias("last"), *(F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(n) for n, k in trace.KINDS))
    q = counted.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").start()
    try:
        q.processAllAvailable()
    except Exception:
        assert batches is not None or fail_at is not None
    finally:
        q.stop()
    return seen


def expect(rows, ends, start=0):
    out = []
    for e in ends:
        c = trace.counters(rows.where((F.col("event") > start) & (F.col("event") <= e))).first()
        out.append((e, c["settled"], c["examined"], c["improved"]))
    return out


def test_counters_equal_batch_at_every_offset(spark, log, tmp_path):
    rows, path = log
    assert run(spark, path, tmp_path) == expect(rows, [900, 1800, 2700, 3600, 4500, 5000])


@pytest.mark.parametrize("how", [{"batches": 3}, {"fail_at": 2}])
def test_restart_goes_on_where_it_was(spark, log, tmp_path, how):
    rows, path = log
    first = run(spark, path, tmp_path, **how)
    then = run(spark, path, tmp_path)
    want = expect(rows, [900, 1800, 2700, 3600, 4500, 5000])
    assert first == want[: len(first)] and len(first) >= 2
    assert then == want[len(want) - len(then) :] and len(first) + len(then) in (6, 7)  # a batch that wasn't committed runs again
    assert run(spark, path, tmp_path) == []


def test_seek_is_a_new_start(spark, log, tmp_path):
    rows, path = log
    for k, start in enumerate((4200, 1000)):
        got = run(spark, path, tmp_path / str(k), start, 2000)
        ends = [min(5000, start + 2000 * (i + 1)) for i in range(len(got))]
        assert got == expect(rows, ends, start) and ends[-1] == 5000


# ---------------------------------------------------------------- phases
def clock(actions):
    """The machine moved a millisecond at a time."""
    out, phase, running, elapsed, todo = [], "off", False, 0, {}
    for at, n, a in sorted(actions):
        todo.setdefault(at, []).append(a)
    for t in range(min(todo), max(todo) + 20_000):
        if running and phase in ("hold", "fade") and elapsed >= {"hold": phases.HOLD_MS, "fade": phases.FADE_MS}[phase]:
            phase, elapsed = {"hold": "fade", "fade": "preparing"}[phase], 0
            out.append((t, phase, running))
        for a in todo.get(t, []):
            was = phase, running
            if a == "start":
                phase, running, elapsed = "preparing", True, 0
            elif a == "exit":
                phase, running, elapsed = "off", False, 0
            elif phase != "off":
                if a == "ready" and phase == "preparing":
                    phase = "replay"
                if a == "finish" and phase == "replay":
                    phase, elapsed = "hold", 0
                if a == "pause":
                    running = False
                if a == "resume" and phase != "stopped":
                    running = True
                if a == "fail":
                    phase, running = "stopped", False
            if (phase, running) != was:
                out.append((t, phase, running))
        if running and phase in ("hold", "fade"):
            elapsed += 1
    return out


def random_actions(seed):
    rng = random.Random(seed)
    at, out = 1_000, []
    for n in range(40):
        at += rng.choice([0, 1, 500, 1999, 2000, 2500, 6000, 7000])
        out.append((at, n, rng.choice(["start", "ready", "ready", "finish", "finish", "finish", "pause", "resume", "resume", "fail", "exit"] if rng.random() < 0.8 else ["start", "finish"])))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_machine_equals_a_clock(seed):
    actions = random_actions(seed)
    m = phases.Phases()
    got = [x for at, _, a in sorted(actions) for x in m.act(at, a)]
    assert got + m.advance(10**9) == clock(actions)


def test_phase_stream_equals_a_clock(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    by = {f"c{k}": random_actions(100 + k) for k in range(5)}
    rows = [(c, at, n, a) for c, x in by.items() for at, n, a in x] + [("end", 10**8, 0, "start")]
    df = spark.createDataFrame(rows, "client string, at long, n int, action string").select("client", F.timestamp_millis("at").alias("ts"), "n", "action")
    cuts = [0, 20_000, 45_000, 80_000, 10**9]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        df.where((F.unix_millis("ts") >= a) & (F.unix_millis("ts") < b)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
        q = phases.phase_log(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        got.setdefault(r["client"], []).append((r["at"], r["phase"], r["running"]))
    for c, actions in by.items():
        assert sorted(got.get(c, [])) == sorted(clock(actions))
