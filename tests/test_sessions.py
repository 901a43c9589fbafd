"""The session state machine and questions about sessions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests import plain_sessions
from tidewell.operators import sessions as ss

NOW = dt.datetime(2026, 8, 27, 12)
SCHEMA = "session_code string, seq long, at timestamp_ntz, command string, player_id string, game_id string, region string, max_players int, min_players_to_start int"


def play(spark, *commands, most=None, code="S"):
    rows = [(code, k, NOW + dt.timedelta(seconds=k), c, p, "g", "r", most, None) for k, (c, p) in enumerate(commands)]
    return ss.play(spark.createDataFrame(rows, SCHEMA))


def outcome(df):
    return [(r.accepted, r.reason, r.state) for r in df.orderBy("seq").collect()]


def test_life_of_a_session(spark):
    df = play(spark, ("create", "a"), ("join", "b"), ("start", "a"), ("terminate", "a"))
    got = df.orderBy("seq").collect()
    assert [r.state for r in got] == ["WAITING", "STARTING", "ACTIVE", "TERMINATED"]
    assert [r.event_type for r in got] == ["SESSION_CREATED", "PLAYER_JOINED", "SESSION_STARTED", "SESSION_TERMINATED"]
    assert got[0].expires_at == NOW + dt.timedelta(hours=2) and got[2].expires_at == NOW + dt.timedelta(seconds=2, hours=6)
    assert got[1].player_count == 2 and got[3].uptime_seconds == 3 and not got[1].is_full


CASES = [
    ((("join", "a"),), (False, "no such session", None)),
    ((("create", "a"), ("create", "b")), (False, "exists already", "WAITING")),
    ((("create", "a"), ("join", "a")), (False, "already joined", "WAITING")),
    ((("create", "a"), ("start", "a")), (False, "needs 2 players to start", "WAITING")),
    ((("create", "a"), ("join", "b"), ("start", "b")), (False, "only the host can do this", "STARTING")),
    ((("create", "a"), ("join", "b"), ("leave", "a"), ("start", "b")), (False, "needs 2 players to start", "WAITING")),
    ((("create", "a"), ("leave", "a")), (True, None, "TERMINATED")),
    ((("create", "a"), ("leave", "a"), ("join", "b")), (False, "not joinable in state TERMINATED", "TERMINATED")),
    ((("create", "a"), ("leave", "z")), (False, "not in the session", "WAITING")),
    ((("create", "a"), ("dance", "a")), (False, "unknown command", "WAITING")),
    ((("create", "a"), ("join", "b"), ("leave", "a"), ("terminate", "b")), (True, None, "TERMINATED")),
    ((("create", "a"), ("join", "b"), ("start", "a"), ("join", "c")), (True, None, "ACTIVE")),
]


def test_refusals_and_moves(spark):
    rows = [(f"S{n:02}", k, NOW + dt.timedelta(seconds=k), c, p, "g", "r", None, None) for n, (commands, _) in enumerate(CASES) for k, (c, p) in enumerate(commands)]
    got: dict = {}
    for r in ss.play(spark.createDataFrame(rows, SCHEMA)).orderBy("session_code", "seq").collect():
        got[r.session_code] = (r.accepted, r.reason, r.state)
    assert [got[c] for c in sorted(got)] == [last for _, last in CASES]


def test_full_session(spark):
    assert outcome(play(spark, ("create", "a"), ("join", "b"), ("join", "c"), most=2))[-1] == (False, "full", "STARTING")


def test_many_sessions_in_one_task(spark):
    rows = [(f"S{n}", k, NOW, c, p, "g", "r", None, None) for n in range(50) for k, (c, p) in enumerate((("create", "a"), ("join", "b")))]
    df = ss.play(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    assert df.where("accepted").count() == 100
    assert ss.latest(df).where("state = 'STARTING'").count() == 50


def test_finders_and_gauges(spark):
    every = play(spark, ("create", "a"), code="W").union(play(spark, ("create", "a"), ("join", "b"), code="T")).union(play(spark, ("create", "c"), ("join", "b"), ("start", "c"), code="A")).union(play(spark, ("create", "a"), ("leave", "a"), code="X"))
    now = ss.latest(every).cache()
    codes = lambda df: sorted(r.session_code for r in df.collect())
    assert codes(ss.open_sessions(now, "g", "r")) == ["A", "W"]
    assert codes(ss.open_sessions(now, "g", "r", ("WAITING", "STARTING", "ACTIVE"))) == ["A", "T", "W"]
    assert codes(ss.of_player(now, "b")) == ["A", "T"] and codes(ss.of_player(now, "a")) == ["T", "W"]
    assert codes(ss.by_code(now, "X")) == ["X"]
    assert ss.count_by_game(now, "WAITING").first() == ("g", 1)
    assert tuple(ss.gauges(now).first()) == (3, 5)
    assert tuple(ss.gauges(now.limit(0)).first()) == (0, 0)


def test_parties_become_sessions(spark):
    members = spark.createDataFrame([("g", "r", 0, s, p) for s, p in enumerate("xyz", 1)], "game_id string, region string, party long, seat int, player_id string").withColumn("at", F.lit(NOW))
    got = ss.latest(ss.play(ss.party_sessions(members))).first()
    assert got.players == ["x", "y", "z"] and got.host_player_id == "x" and got.max_players == 3 and got.is_full


def random_commands():
    rnd = random.Random(6)
    rows = []
    for n in range(40):
        code = f"S{n}" if n else None
        size = rnd.choice((1, 3, 20, 70)) if n != 7 else 400
        for k in range(size):
            command = rnd.choice(("join", "join", "leave", "start", "create", "terminate" if rnd.random() < 0.3 else "join", "dance", None)) if k else "create"
            at = NOW + dt.timedelta(milliseconds=rnd.randrange(100) + 700 * (k // 3))
            rows.append((code, k if rnd.random() < 0.9 else 5, at, command, rnd.choice(("a", "b", "c", "d", None)), rnd.choice(("g", None)), "r", rnd.choice((None, 0, 2, 3)), rnd.choice((None, 1, 3))))
    return rows


@pytest.mark.parametrize("chunk", [16_384, 16])
def test_the_fold_is_what_one_command_at_a_time_does(spark, chunk, monkeypatch):
    monkeypatch.setattr(ss, "PART", 7)
    rows = random_commands()
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    null_first = lambda r: [(x is not None, x) if x is not None else (False,) for x in (r[2], r[1], *r[3:])]
    want = []
    for code in {r[0] for r in rows}:
        s = None
        for r in sorted((r for r in rows if r[0] == code), key=null_first):
            command = dict(zip(names, r, strict=True))
            s, reason = plain_sessions._applied(s, command)
            want.append(plain_sessions._outcome(s, command, reason))
    df = ss.play(spark.createDataFrame(rows, SCHEMA), chunk)
    got = [r.asDict() for r in df.collect()]
    assert all(set(w) <= set(df.columns) for w in want)
    full = sorted((str({c: w.get(c) for c in df.columns}) for w in want))
    assert sorted(str(g) for g in got) == full
    assert {g["reason"] for g in got} >= {None, "full", "already joined", "unknown command", "exists already", "not in the session", "only the host can do this"}


def test_the_fold_has_no_python(spark):
    plan = ss.play(spark.createDataFrame(random_commands(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_no_commands(spark):
    assert ss.play(spark.createDataFrame([], SCHEMA)).count() == 0
