"""Sessions over streams of events in any order against sessions of the whole table and SQL."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import same
from tallyforge import plans
from tallyforge.storage import shared_folder
from tallyforge.streaming import sessions

SF = "/root/testdata/sf0.001"
MINUTE = 60_000_000


@pytest.mark.parametrize("name", ["stream_sessions", "batch_sessions"])
def test_queries_equal_sql(spark, duck, name):
    same(plans.QUERIES[name](spark, SF).toPandas(), duck(plans.ORACLE_SQL[name], SF))


def plain(events, gap):
    out, by = [], {}
    for k, t, v in events:
        if k is not None and t is not None:
            by.setdefault(k, []).append((t, v or 0))
    for k, own in by.items():
        own.sort()
        i = 0
        for j in range(1, len(own) + 1):
            if j == len(own) or own[j][0] - own[j - 1][0] > gap:
                out.append((k, own[i][0], own[j - 1][0], j - i, sum(v for _, v in own[i:j])))
                i = j
    return sorted(out)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9)), max_size=25), st.integers(0, 5))
def test_merging_in_any_order(events, gap):
    state = []
    for t, v in events:
        state = sessions.merged([*state, [t, t, 1, v, [(t,)]]], gap)
    assert [("k", *s[:4]) for s in state] == plain([("k", t, v) for t, v in events], gap)
    assert sum(len(s[4]) for s in state) == len(events)


def replay(spark, parts, **options):
    folder = shared_folder(spark)
    schema = "user string, us long, value long"
    for i, part in enumerate(parts):  # one file is one micro-batch, in the order of writing
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/p={i:03}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/in").withColumn("ts", F.timestamp_micros("us"))
    return sessions.replayed(spark, stream, "user", "ts", F.col("value"), 10 * MINUTE, folder=folder, **options)


@pytest.mark.parametrize("eager", [True, False])
def test_shuffled_replay_equals_the_batch(spark, eager):
    r = random.Random(4)
    events = [(r.choice(["a"] * 5 + ["b", "c", None]), r.choice([None] + [r.randint(0, 600) * MINUTE] * 30), r.choice([None, 1, 2, 30])) for _ in range(160)]
    r.shuffle(events)
    parts = [events[i::4] for i in range(4)]
    if not eager:  # two last events move the time on, so that all is sent
        parts += [[("last", 5000 * MINUTE, 0)], [("last", 9000 * MINUTE, 0)]]
    changes = replay(spark, parts, delay_us=1000 * MINUTE, eager=eager)
    rows = [tuple(x) for x in changes.collect()]
    held = sorted(tuple(x) for x in sessions.standing(changes).collect() if x["key"] != "last")
    assert held == plain(events, 10 * MINUTE)
    assert any(x[-1] == -1 for x in rows)
    whole = spark.createDataFrame(events, "user string, us long, value long").withColumn("ts", F.timestamp_micros("us"))
    assert sorted(tuple(x) for x in sessions.batch_sessions(whole, "user", "ts", F.col("value"), 10 * MINUTE).collect()) == held


def test_late_events_correct_what_was_sent(spark):
    day = 1440
    at = lambda m, v=1: ("a", (day + m) * MINUTE, v)
    # both are sent by the third batch, taken back and joined by the late event of minute 8, which bridges them
    parts = [[at(0), at(15)], [at(40)], [at(45)], [at(8)], [at(500)], [at(501)], [at(502)], [at(1), at(2000)], [at(3000)]]
    changes = [tuple(x) for x in replay(spark, parts, delay_us=60 * MINUTE, eager=False).collect()]
    one, two, both = ((*at(a)[:2], at(b)[1], n, n) for a, b, n in ((0, 0, 1), (15, 15, 1), (0, 15, 3)))
    assert [(*one, 1), (*two, 1)] == sorted(c for c in changes if c[:5] in (one, two) and c[5] == 1)
    assert [(*one, -1), (*two, -1)] == sorted(c for c in changes if c[:5] in (one, two) and c[5] == -1)
    assert changes.count((*both, 1)) == 1 and (*both, -1) not in changes
    # minute 1 came behind the watermark of its batch: too late to change anything
    assert not any(c[1] == at(1)[1] for c in changes)


@pytest.mark.parametrize("eager", [True, False])
def test_a_key_has_one_timer_for_all_its_sessions(eager):
    class Handle:
        timers = []
        registerTimer = timers.append  # noqa: N815

    class State:
        put = clear = lambda self, rows=None: None

    state = sessions.Sessions(10, 1000, eager)
    state.handle, state.open = Handle(), State()
    list(state._settled(("a",), [[t, t, 1, 1, []] for t in range(50_000, 90_000, 100)], 40_000))
    assert Handle.timers == [51 if eager else 50]
    Handle.timers.clear()
    assert len(list(state._settled(("a",), [[t, t, 1, 1, [(t, t, 1, 1)]] for t in (1000, 2000)], 3000))) == 0 and not Handle.timers


def test_the_state_store_is_asked_for(spark):
    events = spark.range(1).selectExpr("id AS user", "timestamp_micros(id) AS ts")
    with pytest.raises(ValueError, match="RocksDB"):
        sessions.session_changes(events, "user", "ts", F.lit(1), 1, 1)
