"""Parsing and quality rules, one fault per rule."""

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import START
from tidewell.functions import quality
from tidewell.functions.contract import ENVELOPE, SILVER_SCHEMA, TABLE_SCHEMAS, empty, struct
from tidewell.operators.envelope import DEDUP_KEY, parse, prepare
from tidewell.operators.generate import event_lines, session_events

ALL = [r for r in (
    "envelope_parses", "event_time_parses", "event_type_known", "session_code_present", "game_id_present", "region_present", "session_state_known",
    "player_count_non_negative", "max_players_positive", "player_count_within_capacity", "schema_version_supported",
)]


def bronze(spark, lines):
    rows = [(line, -1, -1) for line in lines]
    return spark.createDataFrame(rows, "raw_value string, source_partition int, source_offset long").withColumn("ingest_time", F.current_timestamp())


def changed(**fields):
    event = session_events(1, START)[0]
    for path, value in fields.items():
        at = event
        *outer, last = path.split("__")
        for part in outer:
            at = at[part]
        if value is ...:
            del at[last]
        else:
            at[last] = value
    return json.dumps(event)


@pytest.mark.parametrize(
    ("line", "failures"),
    [
        ("this is not json at all", ALL),
        ('{"eventId":"broken-json",', ALL),
        ("[]", ALL),
        ("{}", ALL),
        (dict(eventTime="not-a-timestamp"), ["event_time_parses"]),
        (dict(type="PLAYER_TELEPORTED"), ["event_type_known"]),
        (dict(sessionCode=""), ["session_code_present"]),
        (dict(sessionCode=...), ["session_code_present"]),
        (dict(session__gameId=...), ["game_id_present"]),
        (dict(session__gameId=""), []),
        (dict(session__region=...), ["region_present"]),
        (dict(session__state="GONE"), ["session_state_known"]),
        (dict(session__currentPlayerCount=-3), ["player_count_non_negative"]),
        (dict(session__currentPlayerCount=9), ["player_count_within_capacity"]),
        (dict(session__maxPlayers=0), ["max_players_positive", "player_count_within_capacity"]),
        (dict(schemaVersion=99), ["schema_version_supported"]),
        (dict(session__metadata={"a": "b"}, extra=1), []),
        (dict(eventTime="2026-08-27T09:00:00Z"), []),
    ],
)
def test_each_fault_reports_its_rules(spark, line, failures):
    line = changed(**line) if isinstance(line, dict) else line
    got = prepare(bronze(spark, [line])).select(quality.FAILURES).first()[0]
    assert got == failures


def test_generated_events_are_all_valid_and_typed(spark):
    prepared = prepare(bronze(spark, event_lines(40, START)))
    assert prepared.where(~quality.is_valid()).count() == 0
    first = prepared.where("event_type = 'SESSION_CREATED'").first()
    assert first["player_count"] == 1 and first["uptime_seconds"] == 0 and first["session_state"] == "WAITING"
    assert first["event_time"] is not None and first["session_created_at"] is not None


def test_dedup_key_falls_back_to_a_hash(spark):
    got = prepare(bronze(spark, ["junk", changed()])).select("event_id", DEDUP_KEY, F.sha2("raw_value", 256)).collect()
    for event_id, key, digest in got:
        assert key == (event_id or digest)


def test_text_is_parsed_once(spark):
    plan = prepare(bronze(spark, ["x"])).where(quality.is_valid())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_split_and_own_rules(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    good, bad = quality.split(df, [quality.Expectation("positive", F.col("x") > 0), quality.Expectation("odd", F.col("x") % 2 == 1)])
    assert [r.x for r in good.collect()] == [1]
    assert sorted((r.quality_failures for r in bad.collect()), key=str) == [["positive", "odd"], ["positive", "odd"]]


def test_contract_schemas(spark):
    assert [f.name for f in struct(ENVELOPE)] == ["eventId", "eventTime", "type", "sessionCode", "schemaVersion", "session"]
    for schema, partition_by in TABLE_SCHEMAS.values():
        frame = empty(spark, schema)
        assert frame.count() == 0 and set(partition_by) <= set(frame.columns)
    assert struct(SILVER_SCHEMA).names[-1] == "event_date"


def test_parse_keeps_what_is_asked(spark):
    df = bronze(spark, [changed()]).withColumn("more", F.lit(7))
    assert parse(df, keep=("more",)).columns[-1] == "more"
    assert "raw_value" not in parse(df, keep=("more",)).columns
