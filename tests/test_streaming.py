"""Session chains on a stream against the same in one batch."""

import random

from graphprep.streaming import sessions


def by_definition(rows, gap):
    out = set()
    for key in {r[0] for r in rows}:
        last = None
        for ms, i in sorted({(r[1], r[2]) for r in rows if r[0] == key}):
            if last and ms - last[0] <= gap:
                out.add((str(key), last[2], last[1], i))
                last = (ms, i, last[2])
            else:
                last = (ms, i, i)
    return out


def test_sessions_in_any_order_of_arrival(spark, tmp_path):
    r = random.Random(7)
    rows, now = [], 0
    for i in range(120):
        now += r.choice([1, 5, 20, 200]) * 1000
        rows.append((r.randrange(3), now, i))
    rows += rows[10:15]
    # Files one after another; within ten minutes events come in any order.
    dealt = sorted(rows, key=lambda x: x[1] + r.randrange(100_000))
    for k in range(4):
        part = dealt[k * len(dealt) // 4 : (k + 1) * len(dealt) // 4]
        df = spark.createDataFrame(part, "user long, ms long, id long").selectExpr("user", "timestamp_millis(ms) t", "id")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([(9, now + 10**8, 10_000), (9, now + 2 * 10**8, 10_001)], "user long, ms long, id long").selectExpr("user", "timestamp_millis(ms) t", "id")
    old = spark.conf.get(sessions.STATE_STORE[0])
    spark.conf.set(*sessions.STATE_STORE)
    try:
        for turn in range(2):  # the second run goes on from the first one's state and lets the watermark pass everything
            stream = spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            found = sessions.stream_session_chains(stream, "user", "t", "id", "60 seconds", "10 minutes")
            q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(200)
            assert q.exception() is None and not q.isActive
            if turn == 0:
                end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    finally:
        spark.conf.set(sessions.STATE_STORE[0], old)
    got = [(x.key, x.session, x.src, x.dst) for x in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = by_definition(rows, 60_000)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
