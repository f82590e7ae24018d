"""Queries over the event log: counters, checkpoints, windows, packing, as-of."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import joins, replay, sampler, trace
from ..sources.tables import TRACE_SQL, events_trace, table
from ..streaming.replay import latest_results
from .registry import query

_COUNTS = "sum((kind = 0)::INTEGER)::BIGINT AS settled, sum((kind = 1)::INTEGER)::BIGINT AS examined, sum((kind = 2)::INTEGER)::BIGINT AS improved"


@query(f"WITH {TRACE_SQL} SELECT {_COUNTS} FROM trace")
def trace_counts(spark, sf_dir):
    return trace.counters(events_trace(spark, sf_dir))


@query(f"WITH {TRACE_SQL}, b AS (SELECT (event - 1) // 4096 AS block, count(*) AS events, {_COUNTS} FROM trace GROUP BY 1) SELECT block, sum(events) OVER w::BIGINT AS events, sum(settled) OVER w::BIGINT AS settled, sum(examined) OVER w::BIGINT AS examined, sum(improved) OVER w::BIGINT AS improved FROM b WINDOW w AS (ORDER BY block)".replace("OVER w::BIGINT", "OVER w"))
def trace_checkpoints(spark, sf_dir):
    return trace.checkpoints(events_trace(spark, sf_dir))


@query(f"WITH {TRACE_SQL} SELECT {_COUNTS} FROM trace WHERE event <= floor(0.37 * (SELECT count(*) FROM events))")
def counts_at(spark, sf_dir):
    t = events_trace(spark, sf_dir)
    return trace.counts_at(t, 0.37, t.count())


@query(f"WITH {TRACE_SQL} SELECT {_COUNTS} FROM trace WHERE event <= 4097")
def seek_checkpoint(spark, sf_dir):
    t = events_trace(spark, sf_dir)
    return trace.seek(t, trace.checkpoints(t), 4097)


@query(f"WITH {TRACE_SQL} SELECT id, coalesce(min(event) FILTER (WHERE kind = 1), 0) AS first_examined, coalesce(min(event) FILTER (WHERE kind = 2), 0) AS first_improved FROM trace WHERE kind IN (1, 2) GROUP BY id")
def first_event_per_key(spark, sf_dir):
    return trace.first_events(events_trace(spark, sf_dir))


@query(f"WITH {TRACE_SQL}, t AS (SELECT id, coalesce(min(event) FILTER (WHERE kind = 1), 0) AS f, coalesce(min(event) FILTER (WHERE kind = 2), 0) AS b FROM trace WHERE kind IN (1, 2) GROUP BY id) SELECT id, coalesce(least(nullif(f, 0), nullif(b, 0)), 0) AS first FROM t")
def first_road_event(spark, sf_dir):
    return first_event_per_key(spark, sf_dir).select("id", trace.first_road_event(F.col("first_examined"), F.col("first_improved")).alias("first"))


@query(f"""WITH {TRACE_SQL}, n AS (SELECT count(*) AS n FROM events), t AS (SELECT id, min(event) AS time FROM trace WHERE kind IN (1, 2) GROUP BY id),
b AS (SELECT least(63, time * 64 // (SELECT n FROM n))::INTEGER AS bucket, count(*) AS c FROM t GROUP BY 1)
SELECT k::INTEGER AS bucket, coalesce(c, 0) AS n, sum(coalesce(c, 0)) OVER (ORDER BY k)::BIGINT AS reached FROM range(0, 64) r(k) LEFT JOIN b ON bucket = k""".replace("OVER (ORDER BY k)::BIGINT", "OVER (ORDER BY k)"))
def replay_buckets(spark, sf_dir):
    t = events_trace(spark, sf_dir)
    times = t.where("kind IN (1, 2)").groupBy("id").agg(F.min("event").alias("time"))
    return trace.replay_buckets(times, t.count())


@query(f"WITH {TRACE_SQL}, w AS (SELECT event, (kind | (id << 2) | ((event % 2) << 31)) AS word FROM trace) SELECT event, word, word & 3 AS kind, (word & 2147483647) >> 2 AS id, (word >> 31) & 1 AS side FROM w")
def event_word_pack(spark, sf_dir):
    w = events_trace(spark, sf_dir).select("event", bits.pack_word("kind", "id", F.col("event") % 2).alias("word"))
    return w.select("event", "word", bits.word_kind("word").alias("kind"), bits.word_id("word").alias("id"), bits.word_side("word").alias("side"))


@query(f"WITH {TRACE_SQL}, w AS (SELECT event, (kind | (id << 2) | ((event % 3) << 30)) AS word FROM trace) SELECT event, (word >> 30) & 3 AS source, (word & 1073741823) >> 2 AS id FROM w")
def source_word_pack(spark, sf_dir):
    w = events_trace(spark, sf_dir).select("event", bits.pack_source_word("kind", "id", F.col("event") % 3).alias("word"))
    return w.select("event", bits.word_source("word").alias("source"), bits.word_source_id("word").alias("id"))


@query(f"WITH {TRACE_SQL} SELECT (event - 1) // 4 AS byte, sum(kind << (2 * ((event - 1) % 4)))::INTEGER AS packed FROM trace GROUP BY 1")
def kind_pack(spark, sf_dir):
    return trace.pack_kinds(events_trace(spark, sf_dir))


@query(f"WITH {TRACE_SQL} SELECT event, kind FROM trace")
def kind_unpack(spark, sf_dir):
    t = events_trace(spark, sf_dir)
    return trace.unpack_kinds(trace.pack_kinds(t), t.count())


@query(f"WITH {TRACE_SQL} SELECT id, event, kind, coalesce(last_value(CASE WHEN kind = 0 THEN event_id END IGNORE NULLS) OVER w, -1) AS settled_node, coalesce(last_value(CASE WHEN kind = 1 THEN event_id END IGNORE NULLS) OVER w, -1) AS last_examined FROM trace WINDOW w AS (PARTITION BY id ORDER BY event)")
def current_settled(spark, sf_dir):
    t = events_trace(spark, sf_dir).select(F.col("id").alias("user"), "event", "kind", F.col("event_id").alias("id"))
    return trace.current_settled(t, "user").select(F.col("user").alias("id"), "event", "kind", F.coalesce("settled_node", F.lit(-1)).alias("settled_node"), F.coalesce("last_examined", F.lit(-1)).alias("last_examined"))


@query("SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS value, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS at FROM events")
def asof_focus(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    left = e.select("event_id", "user_id")
    right = e.where("event_type = 'purchase'").select("event_id", "user_id", "value", F.col("event_id").alias("at"))
    return joins.asof(left, right, "event_id", ["user_id"], ["value", "at"], 4096).select("event_id", F.coalesce("value", F.lit(-1.0)).alias("value"), F.coalesce("at", F.lit(-1)).alias("at"))


@query(f"WITH {TRACE_SQL} SELECT count(DISTINCT id) AS unique_keys, count(DISTINCT id) FILTER (WHERE kind = 2) AS improved_keys FROM trace")
def unique_edges(spark, sf_dir):
    t = events_trace(spark, sf_dir)
    return t.agg(F.count_distinct("id").alias("unique_keys"), F.count_distinct(F.when(F.col("kind") == 2, F.col("id"))).alias("improved_keys"))


@query(f"WITH {TRACE_SQL} SELECT id, arg_min(event_id % 3, event) AS source FROM trace GROUP BY id")
def edge_sources(spark, sf_dir):
    return events_trace(spark, sf_dir).groupBy("id").agg(F.min_by(F.col("event_id") % 3, "event").alias("source"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (WHERE i = least(floor(n * 0.5), n - 1)) AS median, max(value) FILTER (WHERE i = least(floor(n * 0.95), n - 1)) AS p95 FROM r GROUP BY event_type")
def frame_percentiles(spark, sf_dir):
    return trace.nearest_rank(table(spark, sf_dir, "events"), "value", {"median": 0.5, "p95": 0.95}, "event_type")


@query("WITH l AS (SELECT user_id, event_id, event_type, count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS x FROM events), v AS (SELECT a.user_id, a.event_id, a.event_type, list(b.event_type) AS before FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) a JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) b ON a.user_id = b.user_id AND b.n BETWEEN a.n - 2 AND a.n - 1 GROUP BY ALL) SELECT count(*) AS repeats FROM v WHERE list_contains(before, event_type)")
def recent_window_violations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return sampler.repeats(e, "event_type", "event_id", 2, ("user_id",)).agg(F.count(F.lit(1)).alias("repeats"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 12")
def last_n_attempts(spark, sf_dir):
    from ..operators.search import recent

    return recent(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", 12)


@query("SELECT user_id, max(event_id) AS request_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stale_results(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), F.col("event_type").alias("value"))
    return latest_results(e).select(F.col("client").alias("user_id"), "request_id", F.col("value").alias("event_type"))


@query("WITH c AS (SELECT event_id AS t, user_id, value AS cursor, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, t FROM c WHERE before < 50 AND cursor >= 50")
def meeting_flash(spark, sf_dir):
    cursors = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("t"), F.col("value").alias("cursor"), F.lit(True).alias("playing"))
    return replay.meeting_flash(cursors, 50, "user_id").select("user_id", "t")


@query("WITH t AS (SELECT event_id, user_id, (epoch_us(ts) // 1000)::BIGINT AS ms FROM events) SELECT user_id, count(*) AS n, sum((gap IS NULL OR gap > 500)::INTEGER)::BIGINT AS bursts FROM (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS gap FROM t) GROUP BY user_id")
def throttle_bursts(spark, sf_dir):
    """How many groups of changes, more than 500 ms apart, each user made."""
    t = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ms"))
    gap = F.col("ms") - F.lag("ms").over(Window.partitionBy("user_id").orderBy("ms", "event_id"))
    t = t.withColumn("gap", gap)
    return t.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("gap").isNull() | (F.col("gap") > 500)).cast("long")).alias("bursts"))


@query("""WITH r AS (SELECT user_id, event_id, event_id % 5 * 100 + 50 AS bytes FROM events),
c AS (SELECT user_id, max(event_id) AS event_id, arg_max(bytes, event_id) AS held FROM r GROUP BY user_id),
f AS (SELECT user_id, max(r.event_id) AS event_id FROM r JOIN c USING (user_id) WHERE r.event_id < c.event_id AND r.bytes + held <= 600 GROUP BY user_id)
SELECT user_id, event_id FROM c UNION ALL SELECT user_id, event_id FROM f""")
def lru_keep(spark, sf_dir):
    """Each user's current release and the latest other one that fits beside it."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("name"), F.col("event_id").alias("used"), (F.col("event_id") % 5 * 100 + 50).alias("bytes"))
    return sampler.kept_releases(e, 600, 2, ("user_id",)).select("user_id", F.col("name").alias("event_id"))


@query(f"WITH {TRACE_SQL}, e AS (SELECT DISTINCT id FROM trace WHERE kind = 2) SELECT id, row_number() OVER (ORDER BY id) - 1 AS row FROM e")
def texture_rows(spark, sf_dir):
    reached = events_trace(spark, sf_dir).where("kind = 2")
    rows, _ = replay.compact_rows(reached, 10**9, "id")
    return rows


@query("WITH s AS (SELECT user_id AS pool, event_id AS key, 1.0 / (1 + event_id % 4) AS weight FROM events), r AS (SELECT *, sum(weight) OVER (PARTITION BY pool ORDER BY key) AS run, sum(weight) OVER (PARTITION BY pool) * 0.4 AS goal FROM s) SELECT pool, min(key) AS key FROM r WHERE run > goal + 1e-9 GROUP BY pool")
def weighted_pick(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("pool"), F.col("event_id").alias("key"), (1.0 / (1 + F.col("event_id") % 4)).alias("weight"))
    total = F.sum("weight").over(Window.partitionBy("pool"))
    return sampler.weighted_pick(s, "weight", "key", F.lit(0.4) + 1e-9 / total, "pool").select("pool", "key")
