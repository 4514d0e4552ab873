"""State machines with deadlines: the table's fold against a plain walk, and the stream's timers against the table."""

import random

from pyspark.sql import functions as F

from granary.streaming import jobs as J

HOUR = 3600.0


def walk(events, now):
    """(state, since) of one key, by looking at every hour-like step alone."""
    state, since = None, None

    def due(t):
        nonlocal state, since
        if state == "pending" and since + 24 * HOUR <= t:
            state, since = "expired", since + 24 * HOUR
        elif state == "processing" and since + 12 * HOUR <= t:
            state, since = "failed", since + 12 * HOUR

    for at, _, event in sorted(events):
        due(at)
        if (state, event) == (None, "submit"):
            state, since = "pending", at
        elif (state, event) == ("pending", "claim"):
            state, since = "processing", at
        elif state == "processing" and event in ("complete", "fail"):
            state, since = {"complete": "completed", "fail": "failed"}[event], at
    due(now)
    return state, since


def test_states_against_a_plain_walk(spark):
    random.seed(9)
    rows = [(k, random.randrange(60) * HOUR, n, random.choice(["submit", "claim", "complete", "fail", "other"])) for n, k in enumerate(random.choices(range(60), k=400))]
    rows += [(None, 0.0, 900, "submit"), (99, 0.0, 901, "submit"), (98, 36 * HOUR, 902, "submit"), (98, 60 * HOUR, 903, "claim"), (97, 36.0 * HOUR, 904, "submit"), (97, 60 * HOUR - 1, 905, "claim")]
    found = {r.key: (r.state, r.since) for r in J.states(spark.createDataFrame(rows, "key long, at double, event_id long, event string"), J.JOBS, 60 * HOUR).collect()}
    expected = {k: walk([r[1:] for r in rows if r[0] == k], 60 * HOUR) for k in {r[0] for r in rows} - {None}}
    assert found == expected
    assert found[99] == ("expired", 24 * HOUR) and found[98] == ("expired", 60 * HOUR) and found[97] == ("processing", 60 * HOUR - 1)


def test_queue_heads_and_sessions(spark):
    jobs = spark.createDataFrame([(3, "pending", 5.0, "a"), (2, "pending", 5.0, "a"), (1, "completed", 1.0, "a"), (4, "processing", 1.0, "b")], "key long, state string, created double, queue string")
    assert list(map(tuple, J.next_pending(jobs, "queue").collect())) == [("a", 2, 2)]
    sessions = spark.createDataFrame([(1, 10.0), (1, 11.0), (2, 99.0), (3, 99.0), (4, 99.0)], "user_id long, expires_at double")
    users = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, "c", None)], "user_id long, email string, secret string")
    assert list(map(tuple, J.valid_sessions(sessions, users, 10.0).collect())) == [(1, 11.0, "a")]


def test_stream_timers_move_states_as_the_table_does(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source, schema = str(tmp_path / "in"), "key long, ts timestamp, event_id long, event string"
        start = 1_700_000_000.0  # the watermark begins at the epoch: nothing may be as old
        first = [(1, 0.0, 1, "submit"), (2, 0.0, 2, "submit"), (2, HOUR, 3, "claim"), (3, 0.0, 4, "submit"), (3, HOUR, 5, "claim"), (3, 2 * HOUR, 6, "complete")]
        later = [(9, 40 * HOUR, 7, "submit"), (2, 40 * HOUR, 8, "complete")]
        last = [(9, 42 * HOUR, 9, "other")]

        def add(rows):
            frame = spark.createDataFrame(rows, "key long, at double, event_id long, event string")
            frame.select("key", F.timestamp_micros(((F.col("at") + start) * 1e6).cast("long")).alias("ts"), "event_id", "event").coalesce(1).write.mode("append").parquet(source)

        def run():
            stream = J.state_stream(spark.readStream.schema(schema).parquet(source), J.JOBS)
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

        for rows in (first, later, last):
            add(rows)
            run()
        moves = {}
        for r in spark.read.parquet(str(tmp_path / "out")).orderBy("since").collect():
            moves.setdefault(r.key, []).append((r.state, r.since - start))
        assert moves[1] == [("pending", 0.0), ("expired", 24 * HOUR)]
        assert moves[2] == [("pending", 0.0), ("processing", HOUR), ("failed", 13 * HOUR)]
        assert moves[3] == [("pending", 0.0), ("processing", HOUR), ("completed", 2 * HOUR)]
        table = {r.key: (r.state, r.since) for r in J.states(spark.createDataFrame(first + later + last, "key long, at double, event_id long, event string"), J.JOBS, 41 * HOUR).collect()}
        assert {k: v[-1] for k, v in moves.items()} == table
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
