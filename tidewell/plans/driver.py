"""The lakehouse's operators over the driver's tables, each with the SQL that says the same.

The tables hold no session envelopes, so a fixed adapter reads ``events`` as
session events, ``customer`` as waiting players and ``orders`` as sessions.  The
SQL repeats the adapter and then asks for the result directly.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import quality
from tidewell.functions.contract import CONCURRENCY_KEY, EVENT_TYPES, LIFECYCLE_KEY, SESSION_STATES
from tidewell.functions.scalars import ExpandingWindow, rating_or_default
from tidewell.operators import envelope, gold, layout, matchmaking, merge, neighbours, sessions
from tidewell.operators.percentile import percentiles
from tidewell.operators.ranking import group_rank
from tidewell.options import BRONZE, CONCURRENCY, DURATION, FUNNEL, LIFECYCLE, QUARANTINE, SILVER, Drive, LakeOptions
from tidewell.plans.catalog import PACK, layout_queries
from tidewell.sources.table import LakeTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query with its SQL."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


# The adapter, in both languages

_TYPE = {"signup": "SESSION_CREATED", "click": "PLAYER_JOINED", "error": "PLAYER_LEFT", "view": "SESSION_STARTED", "purchase": "SESSION_TERMINATED"}
_STATE = {"signup": "WAITING", "click": "STARTING", "error": "ACTIVE", "view": "ACTIVE", "purchase": "TERMINATED"}
_GAMES = "CASE user_id % 4 WHEN 0 THEN 'cyberpunk-2077' WHEN 1 THEN 'fortnite' WHEN 2 THEN 'rocket-league' ELSE 'apex-legends' END"
_REGIONS = "CASE ((user_id - user_id % 4) / 4) % 4 WHEN 0 THEN 'us-west-2' WHEN 1 THEN 'us-east-1' WHEN 2 THEN 'eu-central-1' ELSE 'ap-northeast-1' END"
_COLUMNS = {
    "event_id": "concat('E', CAST(event_id AS {text}))",
    "event_time": "ts",
    "event_type": "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPE.items()) + " ELSE event_type END",
    "session_code": "concat('S', CAST(user_id AS {text}))",
    "schema_version": "CASE WHEN event_id % 103 = 0 THEN 99 ELSE 1 END",
    "game_id": f"CASE WHEN event_id % 89 = 0 THEN NULL ELSE {_GAMES} END",
    "region": f"CASE WHEN event_id % 83 = 0 THEN NULL ELSE {_REGIONS} END",
    "session_state": "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATE.items()) + " ELSE event_type END",
    "player_count": "CAST(event_id % 6 AS INT)",
    "max_players": "4",
    "uptime_seconds": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 1800 END",
}
_EV = "ev AS (SELECT " + ", ".join(f"{v.format(text='VARCHAR')} AS {k}" for k, v in _COLUMNS.items()) + ", event_id AS n FROM events)"


#: The session events as a common table expression; and with the value that the event table has for them.
sql_events = f"{_EV}, timed AS (SELECT ev.*, e.value FROM ev JOIN events e ON ev.n = e.event_id)"


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_RULES = {
    "envelope_parses": "event_id IS NOT NULL",
    "event_time_parses": "event_time IS NOT NULL",
    "event_type_known": f"event_type IN {_in(EVENT_TYPES)}",
    "session_code_present": "session_code IS NOT NULL AND session_code <> ''",
    "game_id_present": "game_id IS NOT NULL",
    "region_present": "region IS NOT NULL",
    "session_state_known": f"session_state IN {_in(SESSION_STATES)}",
    "player_count_non_negative": "player_count >= 0",
    "max_players_positive": "max_players > 0",
    "player_count_within_capacity": "player_count <= max_players",
    "schema_version_supported": "schema_version <= 1",
}
_BROKEN = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN NULL ELSE '{n}' END" for n, c in _RULES.items()) + "], lambda x: x IS NOT NULL)"
_GOOD = "good AS (SELECT * FROM ev WHERE " + " AND ".join(f"coalesce({c}, false)" for c in _RULES.values()) + ")"
_BASE = f"WITH {_EV}, {_GOOD}"
#: For the other modules: rules by name, the list of those that a row breaks, and the events that break none.
sql_rules, sql_broken, sql_base = _RULES, _BROKEN, _BASE


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as session events; some break rules."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(*[f"{v.format(text='STRING')} AS {k}" for k, v in _COLUMNS.items()], "event_id AS n")


def good_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session events that meet all rules."""
    return quality.split(session_events(spark, sf_dir))[0]


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session events as JSON envelopes, every 97th cut short."""
    return envelopes(session_events(spark, sf_dir))


def envelopes(e: DataFrame) -> DataFrame:
    """Session events as JSON, some with a time that is none, some cut short."""
    time = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    session = F.struct(
        F.col("session_code").alias("sessionCode"), F.col("game_id").alias("gameId"), F.col("region"), F.col("session_state").alias("state"),
        F.struct(F.concat("session_code", F.lit("-p0")).alias("playerId")).alias("host"), F.col("player_count").alias("currentPlayerCount"),
        F.col("max_players").alias("maxPlayers"), F.lit(2).alias("minPlayersToStart"), (F.col("player_count") >= F.col("max_players")).alias("isFull"),
        F.col("uptime_seconds").alias("uptimeSeconds"),
    )
    body = F.to_json(
        F.struct(F.col("event_id").alias("eventId"), F.when(F.col("n") % 91 == 0, "not-a-timestamp").otherwise(time).alias("eventTime"), F.col("event_type").alias("type"), F.col("session_code").alias("sessionCode"), F.col("schema_version").alias("schemaVersion"), session.alias("session"))
    )
    return e.select(body.alias("body"), "n").select(F.when(F.col("n") % 97 == 0, F.substring("body", 1, 25)).otherwise(F.col("body")).alias("raw_value"), "n")


def waiting_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as waiting players."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.selectExpr(
        "c_mktsegment AS game_id",
        "concat('r', CAST(c_nationkey % 4 AS STRING)) AS region",
        "concat('p', lpad(CAST(c_custkey AS STRING), 9, '0')) AS player_id",
        "CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE CAST(greatest(0, floor(c_acctbal / 4)) AS INT) END AS rating",
        "TIMESTAMP_NTZ'2026-08-27 12:00:00' - make_interval(0, 0, 0, 0, 0, 0, c_custkey % 120) AS enqueued_at",
    )


_PLAYERS = """players AS (
  SELECT c_mktsegment AS game_id, concat('r', CAST(c_nationkey % 4 AS VARCHAR)) AS region,
         concat('p', lpad(CAST(c_custkey AS VARCHAR), 9, '0')) AS player_id,
         CASE WHEN c_custkey % 50 = 0 THEN 1200 ELSE CAST(greatest(0, floor(c_acctbal / 4)) AS INT) END AS rating,
         TIMESTAMP '2026-08-27 12:00:00' - to_seconds(c_custkey % 120) AS enqueued_at
  FROM customer),
anchors AS (
  SELECT *, least(600, 100 + 25 * date_diff('second', enqueued_at, TIMESTAMP '2026-08-27 12:00:00')) AS width,
         date_diff('second', enqueued_at, TIMESTAMP '2026-08-27 12:00:00') AS wait
  FROM (SELECT *, row_number() OVER (PARTITION BY game_id, region ORDER BY enqueued_at, player_id) AS rn FROM players) WHERE rn = 1)"""

#: The waiting players, and each queue's longest-waiting one, as common table expressions.
sql_players = _PLAYERS


def now() -> Column:
    """The adapter's fixed clock."""
    return F.expr("TIMESTAMP_NTZ'2026-08-27 12:00:00'")


def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as sessions."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    states = ", ".join(f"'{s}'" for s in SESSION_STATES)
    return o.selectExpr(
        "concat('S', CAST(o_orderkey AS STRING)) AS session_code",
        "concat('game-', CAST(o_custkey % 7 AS STRING)) AS game_id",
        "concat('r', CAST(o_custkey % 4 AS STRING)) AS region",
        f"element_at(array({states}), CAST(o_orderkey % 5 + 1 AS INT)) AS state",
        "transform(sequence(1, CAST(o_orderkey % 4 + 1 AS INT)), i -> concat('p', CAST((o_custkey + i) % 100 AS STRING))) AS players",
        "CAST(o_orderkey % 4 + 1 AS INT) AS player_count",
        "4 AS max_players",
        "o_orderdate AS created_at",
    )


_SESSIONS = f"""sessions AS (
  SELECT concat('S', CAST(o_orderkey AS VARCHAR)) AS session_code, concat('game-', CAST(o_custkey % 7 AS VARCHAR)) AS game_id,
         concat('r', CAST(o_custkey % 4 AS VARCHAR)) AS region,
         ([{", ".join(f"'{s}'" for s in SESSION_STATES)}])[o_orderkey % 5 + 1] AS state,
         list_transform(range(1, o_orderkey % 4 + 2), lambda i: concat('p', CAST((o_custkey + i) % 100 AS VARCHAR))) AS players,
         CAST(o_orderkey % 4 + 1 AS INT) AS player_count, 4 AS max_players, o_orderdate AS created_at
  FROM orders)"""


# Rollups


def _half_up(value: str, digits: int) -> str:
    """SQL that rounds a number as Spark does, in decimals and halves up: DuckDB's own rounding of doubles makes 2.17 of 2.175 and 2.68 of 2.675."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


_LIFE_SELECT = """SELECT date_trunc('minute', event_time) AS window_start, date_trunc('minute', event_time) + INTERVAL 1 MINUTE AS window_end, game_id, region,
  count(*) FILTER (event_type = 'SESSION_CREATED')::BIGINT AS sessions_created, count(*) FILTER (event_type = 'SESSION_STARTED')::BIGINT AS sessions_started,
  count(*) FILTER (event_type = 'SESSION_TERMINATED')::BIGINT AS sessions_terminated, count(*) FILTER (event_type = 'PLAYER_JOINED')::BIGINT AS player_joins,
  count(*) FILTER (event_type = 'PLAYER_LEFT')::BIGINT AS player_leaves, count(*) AS event_count, count(DISTINCT session_code) AS distinct_sessions,
  max(player_count) AS peak_players_in_a_session FROM good GROUP BY 1, 2, 3, 4"""
_CONC_SELECT = """SELECT date_trunc('minute', event_time) AS window_start, date_trunc('minute', event_time) + INTERVAL 1 MINUTE AS window_end, region,
  count(DISTINCT session_code) AS active_sessions, sum(player_count)::BIGINT AS player_slot_events, max(player_count) AS peak_session_size,
  count(*) AS event_count FROM good GROUP BY 1, 2, 3"""
_DUR_SELECT = """SELECT *, coalesce(reported_uptime_seconds, observed_duration_seconds) AS duration_seconds, terminate_events > 0 AS completed FROM (
  SELECT *, CAST(floor(epoch(last_event_at)) AS BIGINT) - CAST(floor(epoch(first_event_at)) AS BIGINT) AS observed_duration_seconds FROM (
  SELECT session_code, max(game_id) AS game_id, max(region) AS region, min(event_time) AS first_event_at, max(event_time) AS last_event_at,
  max(player_count) AS peak_players, max(max_players) AS capacity, count(*) AS event_count,
  count(*) FILTER (event_type = 'SESSION_STARTED')::BIGINT AS start_events, count(*) FILTER (event_type = 'SESSION_TERMINATED')::BIGINT AS terminate_events,
  list(uptime_seconds ORDER BY event_time DESC, event_id DESC)[1]::BIGINT AS reported_uptime_seconds
  FROM good GROUP BY session_code))"""
_FUNNEL_SELECT = f"""SELECT *, {_half_up("sessions_started / sessions_observed", 4)} AS start_rate FROM (
  SELECT game_id, region, count(*) AS sessions_observed, count(*) FILTER (start_events > 0)::BIGINT AS sessions_started,
  count(*) FILTER (terminate_events > 0)::BIGINT AS sessions_terminated, quantile_disc(duration_seconds, 0.5) AS p50_duration_seconds,
  quantile_disc(duration_seconds, 0.95) AS p95_duration_seconds, avg(peak_players) AS avg_peak_players FROM durations GROUP BY game_id, region)"""
_LIFE_SQL = f"{_BASE} {_LIFE_SELECT}"
_CONC_SQL = f"{_BASE} {_CONC_SELECT}"
_DUR_SQL = f"{_BASE} {_DUR_SELECT}"
_FUNNEL_SQL = f"{_BASE}, durations AS ({_DUR_SELECT}) {_FUNNEL_SELECT}"


@query("lifecycle_1m", _LIFE_SQL)
def lifecycle_1m(spark, sf_dir):
    return gold.lifecycle(good_events(spark, sf_dir), exact=True)


@query("concurrency_1m", _CONC_SQL)
def concurrency_1m(spark, sf_dir):
    return gold.concurrency(good_events(spark, sf_dir), exact=True)


@query("lifecycle_hourly", _LIFE_SQL.replace("date_trunc('minute', event_time)", "date_trunc('hour', event_time)").replace("INTERVAL 1 MINUTE", "INTERVAL 1 HOUR"))
def lifecycle_hourly(spark, sf_dir):
    return gold.lifecycle(good_events(spark, sf_dir), "1 hour", exact=True)


@query("session_durations", _DUR_SQL)
def session_durations(spark, sf_dir):
    return gold.session_durations(good_events(spark, sf_dir))


@query("matchmaking_funnel", _FUNNEL_SQL)
def matchmaking_funnel(spark, sf_dir):
    return gold.matchmaking_funnel(session_durations(spark, sf_dir))


@query("approx_distinct_sessions")
def approx_distinct_sessions(spark, sf_dir):
    return gold.concurrency(good_events(spark, sf_dir), "1 day")


@query("approx_within_error", f"{_BASE} SELECT region, count(DISTINCT session_code) AS exact_sessions, true AS within FROM good GROUP BY 1")
def approx_within_error(spark, sf_dir):
    """The sketch count of the rollups is within four standard errors (of 5 %) of the exact one."""
    good = good_events(spark, sf_dir)
    counts = good.groupBy("region").agg(F.approx_count_distinct("session_code").alias("near"), F.countDistinct("session_code").alias("exact_sessions"))
    return counts.select("region", "exact_sessions", (F.abs(F.col("near") - F.col("exact_sessions")) <= 0.2 * F.col("exact_sessions")).alias("within"))


# Quality and parsing


@query("quality_failures", f"WITH {_EV} SELECT event_id, array_to_string({_BROKEN}, ',') AS failures, len({_BROKEN})::INT AS failure_count FROM ev")
def quality_failures(spark, sf_dir):
    marked = quality.annotate(session_events(spark, sf_dir))
    return marked.select("event_id", F.array_join(quality.FAILURES, ",").alias("failures"), F.size(quality.FAILURES).alias("failure_count"))


@query("quality_split", f"WITH {_EV} SELECT len({_BROKEN}) = 0 AS valid, count(*) AS n FROM ev GROUP BY 1")
def quality_split(spark, sf_dir):
    good, bad = quality.split(session_events(spark, sf_dir))
    parts = good.select(F.lit(True).alias("valid")).unionAll(bad.select(F.lit(False).alias("valid")))
    return parts.groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


_PARSE_SQL = f"""WITH {_EV} SELECT
  CASE WHEN n % 97 <> 0 THEN event_id END AS event_id,
  CASE WHEN n % 97 <> 0 AND n % 91 <> 0 THEN epoch_us(event_time) ELSE -1 END AS event_us,
  CASE WHEN n % 97 <> 0 THEN event_type END AS event_type, CASE WHEN n % 97 <> 0 THEN session_code END AS session_code,
  CASE WHEN n % 97 <> 0 THEN schema_version END AS schema_version, CASE WHEN n % 97 <> 0 THEN game_id END AS game_id,
  CASE WHEN n % 97 <> 0 THEN region END AS region, CASE WHEN n % 97 <> 0 THEN session_state END AS session_state,
  CASE WHEN n % 97 <> 0 THEN concat(session_code, '-p0') END AS host_player_id, CASE WHEN n % 97 <> 0 THEN player_count END AS player_count,
  CASE WHEN n % 97 <> 0 THEN player_count >= max_players END AS is_full, CASE WHEN n % 97 <> 0 THEN uptime_seconds END AS uptime_seconds, n
  FROM ev"""


@query("envelope_parse", _PARSE_SQL)
def envelope_parse(spark, sf_dir):
    parsed = envelope.parse(raw_events(spark, sf_dir), keep=("n",))
    return parsed.select(
        "event_id", F.coalesce(F.unix_micros("event_time"), F.lit(-1)).alias("event_us"), "event_type", "session_code", "schema_version", "game_id", "region",
        "session_state", "host_player_id", "player_count", "is_full", "uptime_seconds", "n",
    )


def _bronze(spark, sf_dir) -> DataFrame:
    raw = raw_events(spark, sf_dir)
    return raw.select("raw_value", F.lit(-1).alias("source_partition"), F.col("n").alias("source_offset"), F.lit("2026-01-01").cast("timestamp").alias("ingest_time"))


_REJECT_EV = f"""WITH {_EV}, parsed AS (
  SELECT CASE WHEN n % 97 <> 0 THEN event_id END AS event_id, CASE WHEN n % 97 <> 0 AND n % 91 <> 0 THEN event_time END AS event_time,
  CASE WHEN n % 97 <> 0 THEN event_type END AS event_type, CASE WHEN n % 97 <> 0 THEN session_code END AS session_code,
  CASE WHEN n % 97 <> 0 THEN schema_version END AS schema_version, CASE WHEN n % 97 <> 0 THEN game_id END AS game_id,
  CASE WHEN n % 97 <> 0 THEN region END AS region, CASE WHEN n % 97 <> 0 THEN session_state END AS session_state,
  CASE WHEN n % 97 <> 0 THEN player_count END AS player_count, CASE WHEN n % 97 <> 0 THEN max_players END AS max_players FROM ev)"""


@query("rejected_reasons", f"{_REJECT_EV} SELECT failure_reason, count(*) AS rows_rejected FROM (SELECT unnest({_BROKEN}) AS failure_reason FROM parsed) GROUP BY 1")
def rejected_reasons(spark, sf_dir):
    bad = envelope.prepare(_bronze(spark, sf_dir)).where(~quality.is_valid())
    return bad.select(F.explode(quality.FAILURES).alias("failure_reason")).groupBy("failure_reason").agg(F.count(F.lit(1)).alias("rows_rejected"))


# Mutations as joins


@query("in_batch_dedup", f"{_BASE} SELECT session_code, event_id, player_count FROM (SELECT *, row_number() OVER (PARTITION BY session_code ORDER BY event_time, event_id) AS rn FROM good) WHERE rn = 1")
def in_batch_dedup(spark, sf_dir):
    return merge.first_of_each(good_events(spark, sf_dir), ["session_code"], "event_time", "event_id").select("session_code", "event_id", "player_count")


@query("insert_if_absent", f"{_BASE} SELECT event_id, session_code FROM good WHERE n % 2 = 1")
def insert_if_absent(spark, sf_dir):
    events = good_events(spark, sf_dir)
    return merge.absent_from(events, events.where("n % 2 = 0"), ["event_id"]).select("event_id", "session_code")


@query("upsert_late_windows", _LIFE_SQL)
def upsert_late_windows(spark, sf_dir):
    """Half the events first, the rest late: touched windows recomputed and replaced give the whole."""
    events = good_events(spark, sf_dir)
    late = events.where("n % 2 = 1")
    first = gold.lifecycle(events.where("n % 2 = 0"), exact=True)
    return merge.upserted(gold.lifecycle(gold.in_touched_windows(events, late), exact=True), first, LIFECYCLE_KEY)


@query("touched_windows", f"{_BASE} SELECT event_id FROM good WHERE date_trunc('minute', event_time) IN (SELECT date_trunc('minute', event_time) FROM good WHERE n % 10 = 3)")
def touched_windows(spark, sf_dir):
    events = good_events(spark, sf_dir)
    return gold.in_touched_windows(events, events.where("n % 10 = 3")).select("event_id")


@query("touching_sessions", f"{_BASE} SELECT event_id FROM good WHERE session_code IN (SELECT session_code FROM good WHERE n % 100 = 3)")
def touching_sessions(spark, sf_dir):
    events = good_events(spark, sf_dir)
    return merge.touching(events, events.where("n % 100 = 3"), ["session_code"]).select("event_id")


# The query pack and the layout queries

# In the pack some sessions never start: those whose code ends in a 4 have their starts taken away.
_NEVER_STARTED = "session_code LIKE 'S%4' AND event_type = 'SESSION_STARTED'"
_PACK_GOOD = f"WITH {_EV.replace('ev AS', 'whole AS')}, ev AS (SELECT * FROM whole WHERE NOT ({_NEVER_STARTED})), {_GOOD}"
_PACK_SQL = (
    f"""{_PACK_GOOD}, life AS ({_LIFE_SELECT}), placed AS (SELECT *, row_number() OVER (ORDER BY sessions_created DESC, window_start, game_id, region) AS place FROM life)
SELECT window_start, game_id, region, sessions_created, player_joins, distinct_sessions FROM placed WHERE place <= 10""",
    f"""{_PACK_GOOD}, load AS ({_CONC_SELECT}), placed AS (SELECT *, row_number() OVER (ORDER BY window_start DESC, region) AS place FROM load)
SELECT window_start, region, active_sessions, peak_session_size, event_count FROM placed WHERE place <= 10""",
    f"""{_PACK_GOOD}, durations AS ({_DUR_SELECT}), funnel AS ({_FUNNEL_SELECT}) SELECT * EXCLUDE (sessions_terminated) REPLACE ({_half_up("avg_peak_players", 2)} AS avg_peak_players) FROM funnel""",
    f"""{_PACK_GOOD}, durations AS ({_DUR_SELECT}), placed AS (SELECT *, row_number() OVER (ORDER BY duration_seconds DESC, session_code) AS place FROM durations)
SELECT session_code, game_id, region, peak_players, capacity, duration_seconds, completed FROM placed WHERE place <= 10""",
    f"""{_PACK_GOOD}, durations AS ({_DUR_SELECT}), never AS (SELECT session_code FROM good GROUP BY 1 HAVING bool_and(event_type <> 'SESSION_STARTED'))
SELECT game_id, region, count(*) AS abandoned, round(avg(peak_players), 2) AS avg_players_reached, round(avg(duration_seconds), 1) AS avg_seconds_before_giving_up
FROM durations SEMI JOIN never USING (session_code) GROUP BY ALL""",
    f"{_PACK_GOOD} SELECT failure_reason, count(*) AS rows_rejected FROM (SELECT unnest({_BROKEN}) AS failure_reason FROM ev) GROUP BY 1",
    f"""{_PACK_GOOD} SELECT count(*) AS bronze_rows, count(*) FILTER (len({_BROKEN}) = 0) AS silver_rows, count(*) FILTER (len({_BROKEN}) > 0) AS quarantined_rows,
  count(DISTINCT event_id) FILTER (len({_BROKEN}) = 0) AS distinct_events_in_silver FROM ev""",
)
_LAYOUT_SQL = {
    "count_all": "SELECT count(*) AS n FROM good",
    "point_lookup_session": "SELECT count(*) FILTER (session_code = 'S7') AS n FROM good",
    "game_region_rollup": "SELECT game_id, region, event_type, count(*) AS n FROM good WHERE (game_id, region) = ('cyberpunk-2077', 'us-west-2') GROUP BY ALL",
    "wide_aggregate": "SELECT event_type, count(*) AS n, sum(player_count) / count(player_count) AS avg_players FROM good GROUP BY ALL",
}


def _pack_tables(spark, sf_dir) -> Callable[[str], DataFrame]:
    """The tables of the pack, worked out from the events when they are asked for."""
    events = session_events(spark, sf_dir).where(f"NOT ({_NEVER_STARTED})")
    good, bad = quality.split(events)
    made = {
        BRONZE: lambda: events, SILVER: lambda: good, QUARANTINE: lambda: bad, LIFECYCLE: lambda: gold.lifecycle(good, exact=True), CONCURRENCY: lambda: gold.concurrency(good, exact=True),
        DURATION: lambda: gold.session_durations(good), FUNNEL: lambda: gold.matchmaking_funnel(gold.session_durations(good)),
    }
    return lambda name: made[name]()


def _register_pack() -> None:
    for k, (plan, oracle) in enumerate(zip(PACK.values(), _PACK_SQL, strict=True), 1):
        query(f"pack_q{k}", oracle)(lambda spark, sf_dir, plan=plan: plan(_pack_tables(spark, sf_dir)))
    for q in layout_queries("S7"):

        def run(spark, sf_dir, q=q):
            good_events(spark, sf_dir).createOrReplaceTempView(SILVER)
            return spark.sql(q.over(SILVER))

        query(f"layout_{q.name}", f"{_BASE} {_LAYOUT_SQL[q.name]}")(run)


_register_pack()


# Matchmaking


@query("longest_waiting", f"WITH {_PLAYERS} SELECT game_id, region, player_id FROM anchors")
def longest_waiting(spark, sf_dir):
    return matchmaking.longest_waiting(waiting_players(spark, sf_dir)).select("game_id", "region", "player_id")


_NEAR = """near AS (SELECT p.*, a.player_id AS anchor_id, a.wait, abs(p.rating - a.rating) AS distance,
  row_number() OVER (PARTITION BY p.game_id, p.region ORDER BY abs(p.rating - a.rating), p.rating, p.player_id) AS place
  FROM players p JOIN anchors a ON p.game_id = a.game_id AND p.region = a.region AND abs(p.rating - a.rating) <= a.width)"""


@query("nearest_k", f"WITH {_PLAYERS}, {_NEAR} SELECT game_id, region, player_id, rating, CAST(distance AS INT) AS distance, CAST(place AS INT) AS place FROM near WHERE place <= 12")
def nearest_k(spark, sf_dir):
    players = waiting_players(spark, sf_dir)
    anchors = matchmaking.longest_waiting(players).select("game_id", "region", F.coalesce("rating", F.lit(1200)).alias("middle_rating"), F.unix_seconds(now().cast("timestamp")).alias("t"), F.unix_seconds(F.col("enqueued_at").cast("timestamp")).alias("since"))
    near = matchmaking.nearest(players, anchors, 12, ExpandingWindow().width_column(F.col("t") - F.col("since")))
    return near.select("game_id", "region", "player_id", "rating", "distance", "place")


@query(
    "nearest_to_all",
    f"""WITH {_PLAYERS}, reach AS (SELECT *, least(600, 100 + 25 * date_diff('second', enqueued_at, TIMESTAMP '2026-08-27 12:00:00')) AS width FROM players),
found AS (SELECT a.game_id, a.region, a.player_id AS anchor_id, a.rating AS anchor_rating, p.player_id, p.rating, abs(p.rating - a.rating) AS distance,
  row_number() OVER (PARTITION BY a.player_id ORDER BY abs(p.rating - a.rating), p.rating, p.player_id) AS place
  FROM reach a JOIN players p ON a.game_id = p.game_id AND a.region = p.region AND abs(p.rating - a.rating) <= a.width)
SELECT game_id, region, anchor_id, anchor_rating, player_id, rating, CAST(distance AS INT) AS distance, CAST(place AS INT) AS place FROM found WHERE place <= 12""",
)
def nearest_to_all(spark, sf_dir):
    """The candidates of every waiting player, each within the window that they have waited for."""
    players = waiting_players(spark, sf_dir)
    waited = F.unix_seconds(now().cast("timestamp")) - F.unix_seconds(F.col("enqueued_at").cast("timestamp"))
    return neighbours.nearest_to_all(players, players, 12, ExpandingWindow().width_column(waited))


_ATTEMPT = f"""WITH {_PLAYERS}, {_NEAR}, seated AS (
  SELECT *, row_number() OVER (PARTITION BY game_id, region ORDER BY player_id <> anchor_id, distance, rating, player_id) AS seat FROM near WHERE place <= 12)
SELECT game_id, region, CAST(seat AS INT) AS seat, player_id, rating, CAST(wait AS BIGINT) AS anchor_wait_seconds FROM seated
WHERE seat <= 4 AND (SELECT count(*) FROM seated s WHERE s.game_id = seated.game_id AND s.region = seated.region AND s.seat <= 4) = 4"""


@query("match_attempt", _ATTEMPT)
def match_attempt(spark, sf_dir):
    return matchmaking.attempt(waiting_players(spark, sf_dir), 4, now())


@query("match_remaining", f"{_ATTEMPT[: _ATTEMPT.rindex('SELECT game_id, region, CAST(seat')]}SELECT game_id, region, count(*) AS waiting FROM players WHERE player_id NOT IN (SELECT player_id FROM seated WHERE seat <= 4 AND (SELECT count(*) FROM seated s WHERE s.game_id = seated.game_id AND s.region = seated.region AND s.seat <= 4) = 4) GROUP BY 1, 2")
def match_remaining(spark, sf_dir):
    players = waiting_players(spark, sf_dir)
    return matchmaking.depth(matchmaking.without(players, matchmaking.attempt(players, 4, now())))


@query("match_quality", f"SELECT game_id, region, CAST(max(rating) - min(rating) AS INT) AS spread, count(*) AS size, max(anchor_wait_seconds) AS anchor_wait_seconds FROM ({_ATTEMPT}) GROUP BY 1, 2")
def match_quality(spark, sf_dir):
    return matchmaking.party_quality(match_attempt(spark, sf_dir))


@query(
    "fifo_parties",
    f"""WITH {_PLAYERS}, placed AS (SELECT *, row_number() OVER (PARTITION BY game_id, region ORDER BY enqueued_at, player_id) AS place,
  count(*) OVER (PARTITION BY game_id, region) AS n FROM players)
SELECT game_id, region, player_id, CAST((place - 1) // 4 AS BIGINT) AS party, CAST((place - 1) % 4 + 1 AS BIGINT) AS seat FROM placed WHERE place <= n // 4 * 4""",
)
def fifo_parties(spark, sf_dir):
    return matchmaking.fifo_parties(waiting_players(spark, sf_dir), 4).select("game_id", "region", "player_id", "party", "seat")


_SPREADS = f"""WITH {_PLAYERS}, placed AS (SELECT *, row_number() OVER (PARTITION BY game_id, region ORDER BY enqueued_at, player_id) AS place,
  count(*) OVER (PARTITION BY game_id, region) AS n FROM players),
spreads AS (SELECT CAST(max(rating) - min(rating) AS INT) AS spread FROM placed WHERE place <= n // 4 * 4 GROUP BY game_id, region, (place - 1) // 4),
ranked AS (SELECT spread, row_number() OVER (ORDER BY spread) AS place, count(*) OVER () AS n FROM spreads), wanted AS (SELECT unnest([50, 95, 99]) AS percent)"""


@query(
    "party_percentiles",
    f"""{_SPREADS} SELECT 'nearest' AS rule, percent, spread AS value FROM ranked, wanted WHERE place = greatest(1, least(n, ceil(percent / 100.0::DOUBLE * n)))
UNION ALL SELECT 'rounded', percent, spread FROM ranked, wanted WHERE place = greatest(1, least(n, round_even(percent / 100.0::DOUBLE * n + 0.5::DOUBLE, 0)))""",
)
def party_percentiles(spark, sf_dir):
    """Rating spread of the parties at the usual percentiles, by both rules of rank."""
    spreads = matchmaking.party_quality(matchmaking.fifo_parties(_rated(spark, sf_dir), 4))
    both = [percentiles(spreads, "spread", (50, 95, 99), rule).select(F.lit(rule).alias("rule"), "percent", "value") for rule in ("nearest", "rounded")]
    return both[0].unionAll(both[1])


@query(
    "queue_percentiles",
    f"""WITH {_PLAYERS}, ranked AS (SELECT game_id, region, rating, row_number() OVER (PARTITION BY game_id, region ORDER BY rating) AS place, count(*) OVER (PARTITION BY game_id, region) AS n FROM players),
wanted AS (SELECT unnest([1, 25, 50, 95, 99]) AS percent)
SELECT game_id, region, percent, rating AS value FROM ranked, wanted WHERE place = greatest(1, least(n, ceil(percent / 100.0::DOUBLE * n)))""",
)
def queue_percentiles(spark, sf_dir):
    """Ratings of each queue at five percentiles; the default rating is a tie of many."""
    return percentiles(_rated(spark, sf_dir), "rating", (1, 25, 50, 95, 99), by=matchmaking.QUEUE)


@query("party_mean", f"{_SPREADS} SELECT count(*) AS parties, round(avg(spread), 4) AS mean_spread FROM spreads")
def party_mean(spark, sf_dir):
    spreads = matchmaking.party_quality(matchmaking.fifo_parties(_rated(spark, sf_dir), 4))
    return spreads.agg(F.count(F.lit(1)).alias("parties"), F.round(F.avg("spread"), 4).alias("mean_spread"))


def _rated(spark, sf_dir) -> DataFrame:
    return waiting_players(spark, sf_dir).withColumn("rating", rating_or_default(F.col("rating")))


_DRAIN = f"""WITH RECURSIVE {_PLAYERS},
d AS (
  SELECT game_id, region, CAST(-1 AS BIGINT) AS party, CAST(0 AS BIGINT) AS wait, list({{'t': enqueued_at, 'p': player_id, 'r': rating}} ORDER BY enqueued_at, player_id) AS waiting,
         CAST([] AS STRUCT(d INTEGER, r INTEGER, p VARCHAR)[]) AS members
  FROM players GROUP BY game_id, region
  UNION ALL
  SELECT game_id, region, party + 1, wait, [w for w in waiting if NOT list_contains([m.p for m in chosen], w.p)], chosen
  FROM (SELECT *, list_prepend({{'d': 0, 'r': head.r, 'p': head.p}}, list_sort([{{'d': abs(x.r - head.r), 'r': x.r, 'p': x.p}} for x in waiting
                 if x.p <> head.p AND abs(x.r - head.r) <= least(600, 100 + 25 * wait)])[1:3]) AS chosen
        FROM (SELECT game_id, region, party, waiting, waiting[1] AS head, date_diff('second', waiting[1].t, TIMESTAMP '2026-08-27 12:00:00') AS wait FROM d WHERE len(waiting) > 0))
  WHERE len(chosen) = 4),
seats AS (SELECT game_id, region, party, wait, members, unnest([1, 2, 3, 4]) AS seat FROM d WHERE party >= 0)
SELECT game_id, region, party, CAST(seat AS INT) AS seat, members[seat].p AS player_id, members[seat].r AS rating, wait AS anchor_wait_seconds FROM seats"""


@query("match_drain", _DRAIN)
def match_drain(spark, sf_dir):
    from datetime import datetime

    return matchmaking.drain(waiting_players(spark, sf_dir), 4, datetime(2026, 8, 27, 12))


@query(
    "fifo_match",
    f"""WITH {_SESSIONS}, p AS (SELECT concat('game-', CAST(c_custkey % 7 AS VARCHAR)) AS game_id, concat('r', CAST(c_custkey % 4 AS VARCHAR)) AS region, c_custkey FROM customer),
head AS (SELECT game_id, region, min(c_custkey) AS k FROM p GROUP BY 1, 2),
open AS (SELECT *, row_number() OVER (PARTITION BY game_id, region ORDER BY created_at, session_code) AS rn FROM sessions WHERE state = 'WAITING' AND player_count < max_players)
SELECT head.game_id, head.region, concat('p', CAST(k AS VARCHAR)) AS player_id, session_code FROM head LEFT JOIN open ON head.game_id = open.game_id AND head.region = open.region AND rn = 1""",
)
def fifo_match(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    players = c.selectExpr(
        "concat('game-', CAST(c_custkey % 7 AS STRING)) AS game_id", "concat('r', CAST(c_custkey % 4 AS STRING)) AS region",
        "concat('p', CAST(c_custkey AS STRING)) AS player_id", "c_custkey AS enqueued_at", "1200 AS rating",
    )
    return matchmaking.fifo_match(players, live_sessions(spark, sf_dir))


@query("group_ranks", f"{_BASE} SELECT session_code, event_id, row_number() OVER (PARTITION BY session_code ORDER BY event_time, event_id) AS rank FROM good")
def group_ranks(spark, sf_dir):
    return group_rank(good_events(spark, sf_dir), ["session_code"], ["event_time", "event_id"]).select("session_code", "event_id", "rank")


# Sessions


@query("sessions_open", f"WITH {_SESSIONS} SELECT session_code, state FROM sessions WHERE game_id = 'game-3' AND region = 'r1' AND state IN ('WAITING', 'ACTIVE')")
def sessions_open(spark, sf_dir):
    return sessions.open_sessions(live_sessions(spark, sf_dir), "game-3", "r1").select("session_code", "state")


@query("sessions_of_player", f"WITH {_SESSIONS} SELECT session_code, state FROM sessions WHERE list_contains(players, 'p42') AND state <> 'TERMINATED'")
def sessions_of_player(spark, sf_dir):
    return sessions.of_player(live_sessions(spark, sf_dir), "p42").select("session_code", "state")


@query("sessions_by_code", f"WITH {_SESSIONS} SELECT session_code, game_id, region, state FROM sessions WHERE session_code = 'S7'")
def sessions_by_code(spark, sf_dir):
    return sessions.by_code(live_sessions(spark, sf_dir), "S7").select("session_code", "game_id", "region", "state")


@query("sessions_count_by_game", f"WITH {_SESSIONS} SELECT game_id, count(*) AS sessions FROM sessions WHERE state = 'ACTIVE' GROUP BY 1")
def sessions_count_by_game(spark, sf_dir):
    return sessions.count_by_game(live_sessions(spark, sf_dir), "ACTIVE")


@query("session_gauges", f"WITH {_SESSIONS} SELECT count(*) AS live_sessions, sum(len(players))::BIGINT AS connected_players FROM sessions WHERE state <> 'TERMINATED'")
def session_gauges(spark, sf_dir):
    return sessions.gauges(live_sessions(spark, sf_dir))


# A player set, a host and a state per session, moved on by one command at a time.
_FOLD = """WITH RECURSIVE commands AS (
  SELECT concat('S', CAST(user_id AS VARCHAR)) AS session_code, event_id AS seq, concat('p', CAST(event_id % 6 AS VARCHAR)) AS player,
         CASE event_type WHEN 'click' THEN 'join' WHEN 'error' THEN 'leave' WHEN 'view' THEN 'start' WHEN 'signup' THEN 'create' ELSE 'terminate' END AS command,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events),
fold AS (
  SELECT session_code, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BOOLEAN) AS accepted, CAST(NULL AS VARCHAR) AS state, CAST([] AS VARCHAR[]) AS players, CAST(NULL AS VARCHAR) AS host
  FROM commands WHERE n = 1
  UNION ALL
  SELECT session_code, n, seq, ok,
         CASE WHEN NOT ok THEN state WHEN command = 'create' THEN 'WAITING' WHEN command = 'start' THEN 'ACTIVE' WHEN command = 'terminate' OR len(after) = 0 THEN 'TERMINATED'
              WHEN command = 'join' AND state = 'WAITING' AND len(after) >= 2 THEN 'STARTING' WHEN command = 'leave' AND state = 'STARTING' AND len(after) < 2 THEN 'WAITING' ELSE state END,
         CASE WHEN ok THEN after ELSE players END,
         CASE WHEN NOT ok THEN host WHEN command = 'create' THEN player WHEN command = 'leave' AND host = player AND len(after) > 0 THEN after[1] ELSE host END
  FROM (SELECT c.session_code, c.n, c.seq, c.command, c.player, f.state, f.players, f.host,
               CASE c.command WHEN 'create' THEN [c.player] WHEN 'join' THEN list_append(f.players, c.player) WHEN 'leave' THEN [x for x in f.players if x <> c.player] ELSE f.players END AS after,
               coalesce(CASE c.command WHEN 'create' THEN f.state IS NULL WHEN 'join' THEN f.state IN ('WAITING', 'STARTING', 'ACTIVE') AND len(f.players) < 4 AND NOT list_contains(f.players, c.player)
                        WHEN 'leave' THEN list_contains(f.players, c.player) WHEN 'start' THEN f.host = c.player AND len(f.players) >= 2 ELSE f.host = c.player END, FALSE) AS ok
        FROM fold f JOIN commands c ON c.session_code = f.session_code AND c.n = f.n + 1))
SELECT session_code, seq, accepted, state, CASE WHEN state IS NOT NULL THEN CAST(len(players) AS INT) END AS player_count, host AS host_player_id FROM fold WHERE n > 0"""


@query("session_fold", _FOLD)
def session_fold(spark, sf_dir):
    """Commands from the event table, played through the state machine."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = "CASE event_type WHEN 'click' THEN 'join' WHEN 'error' THEN 'leave' WHEN 'view' THEN 'start' WHEN 'signup' THEN 'create' ELSE 'terminate' END"
    commands = e.selectExpr(
        "concat('S', CAST(user_id AS STRING)) AS session_code", "event_id AS seq", "ts AS at", f"{kinds} AS command",
        "concat('p', CAST(event_id % 6 AS STRING)) AS player_id", "'g' AS game_id", "'r' AS region", "4 AS max_players", "2 AS min_players_to_start",
    )
    return sessions.play(commands).select("session_code", "seq", "accepted", "state", "player_count", "host_player_id")


# Tables and streams


def scratch(spark: SparkSession) -> str:
    """A new folder in the place that executors share."""
    from tidewell.operators.ranking import shared_folder

    return f"{shared_folder(spark)}/lake-{uuid4().hex}"


def _lake_table(spark, sf_dir) -> LakeTable:
    events = good_events(spark, sf_dir).drop("n").withColumn("event_date", F.to_date("event_time"))
    table = LakeTable(spark, f"{scratch(spark)}/events")
    table.create(events.schema, ["event_date"])
    return table


@query("table_insert_upsert", f"{_BASE} SELECT event_id, CASE WHEN n % 5 = 0 THEN 99 ELSE player_count END AS player_count FROM good")
def table_insert_upsert(spark, sf_dir):
    """Append, insert what is absent, and update, through the table layer."""
    events = good_events(spark, sf_dir).withColumn("event_date", F.to_date("event_time"))
    table = _lake_table(spark, sf_dir)
    table.append(events.where("n % 3 = 0").drop("n"))
    table.insert_if_absent(events.drop("n"), ["event_id"], prune="event_date")
    table.upsert(events.where("n % 5 = 0").withColumn("player_count", F.lit(99)).drop("n"), ["event_id"], prune="event_date")
    return table.read().select("event_id", "player_count")


@query("table_time_travel", f"{_BASE} SELECT * FROM (SELECT 0 AS version, 0 AS row_count UNION ALL SELECT 1, count(*) FROM good WHERE n % 2 = 0 UNION ALL SELECT 2, count(*) FROM good)")
def table_time_travel(spark, sf_dir):
    """Rows visible at each version, counted from the data of that version."""
    events = good_events(spark, sf_dir).withColumn("event_date", F.to_date("event_time"))
    table = _lake_table(spark, sf_dir)
    for part in (0, 1):
        table.append(events.where(F.col("n") % 2 == part).drop("n"))
    counts = [table.read(v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("row_count")) for v in range(3)]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


@query("table_optimized", f"{_BASE} SELECT event_id, session_code, game_id FROM good")
def table_optimized(spark, sf_dir):
    """Compaction with clustering and vacuum leave the rows as they are."""
    events = good_events(spark, sf_dir).withColumn("event_date", F.to_date("event_time"))
    table = _lake_table(spark, sf_dir)
    for part in (0, 1):
        table.append(events.where(F.col("n") % 2 == part).drop("n"))
    table.optimize(["game_id", "session_code"])
    table.vacuum(0)
    return table.read().select("event_id", "session_code", "game_id")


@query(
    "table_history",
    f"""{_BASE} SELECT * FROM (SELECT 0 AS version, 'CREATE' AS operation, 0 AS row_count UNION ALL SELECT 1, 'APPEND', count(*) FROM good WHERE n % 2 = 0
UNION ALL SELECT 2, 'APPEND', count(*) FROM good UNION ALL SELECT 3, 'OPTIMIZE ZORDER BY (game_id, session_code)', count(*) FROM good)""",
)
def table_history(spark, sf_dir):
    """Versions with their operations and rows; a batch that is committed twice counts once."""
    return _compacted(spark, sf_dir)[0].history().select("version", "operation", "row_count")


@query(
    "table_detail",
    f"""{_BASE}, days AS (SELECT count(DISTINCT CAST(event_time AS DATE)) AS days FROM good)
SELECT (SELECT count(*) FROM good) AS rows, 'event_date' AS partition_by, true AS few_after_appends, true AS few_after_optimize, true AS smaller FROM days""",
)
def table_detail(spark, sf_dir):
    """A commit adds at most a file per partition; compaction leaves about one per partition, and fewer bytes."""
    table, before = _compacted(spark, sf_dir)
    after = table.detail()
    days = table.read().select("event_date").distinct().count()
    row = (after.rows, ",".join(after.partition_by), before.files <= 2 * days, after.files <= 2 * days and after.files <= before.files, after.bytes < before.bytes)
    return spark.createDataFrame([row], "rows long, partition_by string, few_after_appends boolean, few_after_optimize boolean, smaller boolean")


def _compacted(spark, sf_dir):
    events = good_events(spark, sf_dir).withColumn("event_date", F.to_date("event_time"))
    table = _lake_table(spark, sf_dir)
    for part in (0, 1, 1):
        table.append(events.where(F.col("n") % 2 == part).drop("n"), txn=("history", part))
    before = table.detail()
    table.optimize(["game_id", "session_code"])
    return table, before


@query("z_order_rows", f"{_BASE} SELECT event_id FROM good")
def z_order_rows(spark, sf_dir):
    return layout.z_ordered(good_events(spark, sf_dir), ["game_id", "session_code"], 8).select("event_id")


def _streamed(spark, sf_dir) -> LakeOptions:
    from tidewell.sources.events import FileEventSource
    from tidewell.streaming import medallion

    options = LakeOptions(base=scratch(spark), drive=Drive.RATE_LIMITED, max_files=2)
    raw_events(spark, sf_dir).select("raw_value").repartition(4).write.text(options.landing)
    medallion.run_all(spark, options, FileEventSource(options))
    return options


@query(
    "stream_silver",
    f"""{_REJECT_EV} SELECT event_id, event_type, session_code, player_count FROM parsed WHERE {" AND ".join(f"coalesce({c}, false)" for c in _RULES.values())}""",
)
def stream_silver(spark, sf_dir):
    """Files through bronze to silver, as streams."""
    options = _streamed(spark, sf_dir)
    return LakeTable(spark, options.table(SILVER)).read().select("event_id", "event_type", "session_code", "player_count")


@query(
    "stream_concurrency",
    f"""{_REJECT_EV}, good AS (SELECT * FROM parsed WHERE {" AND ".join(f"coalesce({c}, false)" for c in _RULES.values())})
SELECT epoch_us(date_trunc('minute', event_time)) AS window_us, region, sum(player_count)::BIGINT AS player_slot_events,
  max(player_count) AS peak_session_size, count(*) AS event_count FROM good GROUP BY 1, 2""",
)
def stream_concurrency(spark, sf_dir):
    """Files through all layers, as streams, to a gold table that is kept up by window."""
    options = _streamed(spark, sf_dir)
    rows = LakeTable(spark, options.table(CONCURRENCY)).read()
    return rows.select(F.unix_micros("window_start").alias("window_us"), *CONCURRENCY_KEY[1:], "player_slot_events", "peak_session_size", "event_count")


def _order_sessions(spark, sf_dir) -> DataFrame:
    """A generated session for each order."""
    from datetime import UTC, datetime

    from tidewell.operators.generate import generated_for

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return generated_for(orders.select(F.col("o_orderkey").alias("number")), datetime(2026, 8, 27, 9, tzinfo=UTC))


@query("generated_sessions")
def generated_sessions(spark, sf_dir):
    lines = _order_sessions(spark, sf_dir)
    return envelope.parse(lines, keep=()).select("event_id", "event_type", "session_code", "player_count", "session_state")


@query(
    "generated_lives",
    """SELECT concat('S', lpad(CAST(n AS VARCHAR), 7, '0')) AS session_code, TRUE AS one_creation_first, TRUE AS one_end_last, TRUE AS joins_add_one, TRUE AS starts_with_two, TRUE AS times_rise FROM (SELECT DISTINCT o_orderkey AS n FROM orders)""",
)
def generated_lives(spark, sf_dir):
    """What holds for the life of every generated session."""
    lines = _order_sessions(spark, sf_dir)
    beats = F.array_sort(F.collect_list(F.struct("beat", "event_type", "event_time", "player_count")))
    lives = envelope.parse(lines, keep=("beat",)).groupBy("session_code").agg(beats.alias("b"))
    kinds = "transform(b, x -> x.event_type)"
    of = "filter({}, x -> x = '{}')".format
    return lives.selectExpr(
        "session_code",
        f"{kinds}[0] = 'SESSION_CREATED' AND size({of(kinds, 'SESSION_CREATED')}) = 1 AS one_creation_first",
        f"element_at({kinds}, -1) = 'SESSION_TERMINATED' AND size({of(kinds, 'SESSION_TERMINATED')}) = 1 AS one_end_last",
        "forall(transform(b, (x, i) -> x.player_count = if(i = 0, 1, b[i - 1].player_count + int(x.event_type = 'PLAYER_JOINED'))), x -> x) AND forall(b, x -> x.player_count BETWEEN 1 AND 4) AS joins_add_one",
        f"size({of(kinds, 'SESSION_STARTED')}) <= 1 AND forall(b, x -> x.event_type <> 'SESSION_STARTED' OR x.player_count >= 2) AS starts_with_two",
        "forall(transform(b, (x, i) -> i = 0 OR x.event_time > b[i - 1].event_time), x -> x) AS times_rise",
    )
