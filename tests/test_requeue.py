"""The queue as a stream: batches, timers and restarts give what one pass over the finished table gives."""

from __future__ import annotations

import random
from collections import Counter

from tallyforge.streaming import leases, requeue


def events(n=240, seed=2):
    rng, t, out = random.Random(seed), 1_700_000_000, []
    for i in range(n):
        t += rng.choice((5, 60, 900, 2400))
        out.append((rng.randint(1, 6), i, t, rng.choice(("claim", "claim", "finish", "evidence"))))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id long, event_id long, ts long, kind string").selectExpr("user_id", "event_id", "timestamp_seconds(ts) AS ts", "kind")


def counted(rows):
    return Counter((r["user_id"], r["generation"], r["state"], r["claims"], int(r["at"].timestamp())) for r in rows.collect())


def test_stream_in_batches_and_after_a_restart_equals_one_pass(spark, tmp_path):
    rows, source, out, state = events(), tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    for i in range(2):
        frame(spark, rows[i * 80 : i * 80 + 80]).coalesce(1).write.mode("append").parquet(str(source))
    run = lambda: leases.run_to_table(requeue.queue(leases.read_events(spark, str(source))), out, state)
    run()
    frame(spark, rows[160:]).coalesce(1).write.mode("append").parquet(str(source))
    run()
    run()  # nothing new
    got = counted(spark.read.schema(requeue.SCHEMA).parquet(out))
    assert got == counted(requeue.queue_batch(frame(spark, rows))) == counted(requeue.queue_batch(frame(spark, rows).repartition(5)))
    assert {s for _, _, s, _, _ in got} == {"completed", "expired", "requeued"} and max(got.values()) == 1
    assert requeue.queue_batch(frame(spark, rows).limit(0)).count() == 0


def test_states():
    state, said = (0, None, False, 0), []
    for kind, t in (("finish", 1), ("claim", 10), ("claim", 20), ("finish", 30), ("claim", 40), ("evidence", 50), ("evidence", 60), ("claim", 70), ("finish", 170)):
        state, out = requeue.advanced(state, kind, t, 100)
        said += out
    # a finish that comes as the claim's time is over finds it expired
    assert said == [(0, "completed", 1, 30), (1, "requeued", 1, 50), (1, "expired", 2, 170)] and state == (1, None, False, 2)
