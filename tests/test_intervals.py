"""The interval join against a plain double loop, and the session-scoped event operators."""

import random

from pyspark.sql import functions as F

from examloom.operators import eventlog as E
from examloom.operators import intervals as I


def test_contain_and_latest_equal_a_double_loop(spark):
    rng = random.Random(2)
    when = lambda: rng.choice([rng.randrange(-50, 300), rng.randrange(-(1 << 40), 1 << 40), rng.randrange(1 << 20)])
    points = [(i, rng.choice([1, 2, None]), when() if i else None) for i in range(300)] + [(300, 1, (1 << 62)), (301, 1, -(1 << 62))]
    ranges = []
    for i in range(120):
        s = when()
        ranges.append((i, rng.choice([1, 2, None]), s, rng.choice([None, s, s - 5, s + 1, s + rng.randrange(200), s + (1 << rng.randrange(61))])))
    ranges += [(200, 1, None, 5), (201, 1, -(1 << 62), None)]
    p = spark.createDataFrame(points, "pid BIGINT, k BIGINT, at BIGINT")
    r = spark.createDataFrame(ranges, "rid BIGINT, k BIGINT, s BIGINT, e BIGINT")
    want = {(pid, rid) for pid, k, at in points for rid, q, s, e in ranges
            if None not in (k, q, at, s) and k == q and s <= at and (e is None or at < e)}
    got = [(x.pid, x.rid) for x in I.contain(p, r, ["k"], "at", "s", "e").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    starts = {rid: s for rid, _, s, _ in ranges}
    best = {}
    for pid, rid in want:
        best[pid] = max(best.get(pid, (-(1 << 63), -1)), (starts[rid], rid))
    last = I.latest(p, r, ["k"], "at", ["pid"], "s", "e", ["s", "rid"]).collect()
    assert {(x.pid, x.s, x.rid) for x in last} == {(pid, *best.get(pid, (None, None))) for pid, _, _ in points}
    assert I.contain(p, r.limit(0), ["k"], "at", "s", "e").count() == 0 and I.contain(p.limit(0), r, ["k"], "at", "s", "e").count() == 0


def test_sessions_scope_ticks_absences_and_time_out(spark):
    s = 1_000_000
    sessions = spark.createDataFrame(
        [(1, 10, 0, 100 * s, 50), (1, 11, 40 * s, 60 * s, None), (1, 12, 200 * s, None, 30)],
        "user_id BIGINT, session_id BIGINT, start_us BIGINT, end_us BIGINT, limit_seconds BIGINT",
    )
    log = [(5, "view", 7), (10, "out", 7), (30, "back", 7), (45, "out", 8), (55, "back", 8), (90, "out", 9), (150, "back", 9),
           (210, "out", 7), (215, "out", 7), (240, "back", 7)]
    events = spark.createDataFrame([(k, 1, t * s, i, kind, 20) for k, (t, kind, i) in enumerate(log)],
                                   "event_id BIGINT, user_id BIGINT, ts_us BIGINT, item INT, type STRING, seconds BIGINT")
    on = E.in_sessions(events, sessions)
    assert [r.session_id for r in on.orderBy("event_id").collect()] == [10, 10, 10, 11, 11, 10, None, 12, 12, 12]
    inside = on.filter("session_id is not null")
    dwell = {(r.session_id, r.item): r.seconds for r in E.dwell_time(inside, E.SESSION).collect()}
    # 10: item 7 from 5 to 90, item 9 from 90 to the end at 100; 11 ends at 60; 12 is open
    assert dwell == {(10, 7): 85.0, (10, 9): 10.0, (11, 8): 15.0, (12, 7): 30.0}
    away = [(r.session_id, r.seconds) for r in E.session_absences(on, "out", "back").orderBy("since_us").collect()]
    assert away == [(10, 20), (12, 30)]  # untimed 11 has none, and nobody came back to 10 before its end
    done = {r.session_id: (r.finished_us // s, r.elapsed) for r in E.auto_finish(inside, keys=E.SESSION).collect()}
    assert done == {10: (30, 60), 12: (215, 40)}
    assert on.filter("session_id is null").count() == 1
    assert E.auto_finish(events.withColumn("limit_seconds", F.lit(0))).count() == 0
