"""Sessions from commands: the life of a session as a fold, and questions about sessions.

Commands are ``create, join, leave, start, terminate``.  Sessions are rows with a
state, a host and an array of players.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.contract import JOINABLE_STATES, LIVE_STATES
from tidewell.functions.scalars import player_total
from tidewell.operators.ranking import group_rank, settled

#: Limits of a session that names none, and its life before and after its start.
MOST_PLAYERS, LEAST_PLAYERS = 4, 2
WAITING_LIFE, ACTIVE_LIFE = timedelta(hours=2), timedelta(hours=6)
COMMANDS = {"create": "SESSION_CREATED", "join": "PLAYER_JOINED", "leave": "PLAYER_LEFT", "start": "SESSION_STARTED", "terminate": "SESSION_TERMINATED"}

#: Commands of a session that are folded at once, and those of them whose outcomes are gathered in one array.
CHUNK, PART = 16_384, 128
#: A session as it is carried from one command to the next.
STATE = (
    "struct<game_id: string, region: string, state: string, host_player_id: string, players: array<string>, max_players: int,"
    " min_players_to_start: int, created_at: timestamp_ntz, updated_at: timestamp_ntz, expires_at: timestamp_ntz>"
)
_OUTCOME = f"struct<seq: bigint, at: timestamp_ntz, command: string, player_id: string, reason: string, s: {STATE}>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _refusal(s: Column, c: Column, known: Column) -> Column:
    """Why a session refuses a command; null if it does not.  ``known``: the player is in the session."""
    command, size = c["command"], F.size(s["players"])
    host = F.when(~s["host_player_id"].eqNullSafe(c["player_id"]), "only the host can do this")
    join = F.when(~s["state"].isin(*JOINABLE_STATES), F.concat(F.lit("not joinable in state "), s["state"])).when(size >= s["max_players"], "full").when(known, "already joined")
    start = F.coalesce(host, F.when(size < s["min_players_to_start"], F.concat(F.lit("needs "), s["min_players_to_start"].cast("string"), F.lit(" players to start"))))
    return (
        F.when(~F.coalesce(command.isin(*COMMANDS), F.lit(False)), "unknown command")
        .when(command == "create", F.when(s["state"].isNotNull(), "exists already"))
        .when(s["state"].isNull(), "no such session")
        .when(command == "join", join)
        .when(command == "leave", F.when(~known, "not in the session"))
        .when(command == "start", start)
        .otherwise(host)
    )


def _moved(s: Column, c: Column) -> Column:
    """The session after a command that it does not refuse."""
    command, player, at = c["command"], c["player_id"], c["at"]
    players = (
        F.when(command == "create", F.array(player))
        .when(command == "join", F.array_append(s["players"], player))
        .when(command == "leave", F.filter(s["players"], lambda p: ~p.eqNullSafe(player)))
        .otherwise(s["players"])
    )
    new = command == "create"
    given = lambda name, default: F.when(new, F.when(F.coalesce(c[name], F.lit(0)) != 0, c[name]).otherwise(F.lit(default))).otherwise(s[name])

    def after(now: Column) -> Column:
        left, waiting = F.size(now), s["state"] == "WAITING"
        state = (
            F.when(new, "WAITING")
            .when(command == "start", "ACTIVE")
            .when((command == "terminate") | (left == 0), "TERMINATED")
            .when((command == "join") & waiting & (left >= s["min_players_to_start"]), "STARTING")
            .when((command == "leave") & (s["state"] == "STARTING") & (left < s["min_players_to_start"]), "WAITING")
            .otherwise(s["state"])
        )
        host = F.when(new, player).when((command == "leave") & s["host_player_id"].eqNullSafe(player) & (left > 0), F.get(now, F.lit(0))).otherwise(s["host_player_id"])
        life = F.when(new, at + F.expr(f"INTERVAL '{WAITING_LIFE.total_seconds():.0f}' SECOND")).when(command == "start", at + F.expr(f"INTERVAL '{ACTIVE_LIFE.total_seconds():.0f}' SECOND"))
        return F.struct(
            F.when(new, c["game_id"]).otherwise(s["game_id"]).alias("game_id"),
            F.when(new, c["region"]).otherwise(s["region"]).alias("region"),
            state.alias("state"),
            host.alias("host_player_id"),
            now.alias("players"),
            given("max_players", MOST_PLAYERS).alias("max_players"),
            given("min_players_to_start", LEAST_PLAYERS).alias("min_players_to_start"),
            F.when(new, at).otherwise(s["created_at"]).alias("created_at"),
            at.alias("updated_at"),
            F.coalesce(life, s["expires_at"]).alias("expires_at"),
        ).cast(STATE)

    return _let(players, after)


def _applied(s: Column, c: Column) -> Column:
    """A command's outcome: why it was refused, and the session after it."""
    known = F.coalesce(F.exists(s["players"], lambda p: p.eqNullSafe(c["player_id"])), F.lit(False))
    outcome = lambda reason: F.struct(
        c["seq"].alias("seq"), c["at"].alias("at"), c["command"].alias("command"), c["player_id"].alias("player_id"), reason.alias("reason"), F.when(reason.isNull(), _moved(s, c)).otherwise(s).alias("s")
    ).cast(_OUTCOME)
    return _let(known, lambda k: _let(_refusal(s, c, k), outcome))


def _folded(commands: Column, before: Column) -> Column:
    """The outcomes of sorted commands, from a state on: parts are folded one after the other and strung together."""
    none = F.array().cast(f"array<{_OUTCOME}>")

    def part(s: Column, cs: Column) -> Column:
        start = F.struct(s.alias("s"), none.alias("out")).cast(f"struct<s: {STATE}, out: array<{_OUTCOME}>>")
        step = lambda a, c: _let(_applied(a["s"], c), lambda o: F.struct(o["s"].alias("s"), F.array_append(a["out"], o).alias("out")))
        return F.aggregate(cs, start, step)

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(commands) - 1) / PART).cast("int")), lambda i: F.slice(commands, i * PART + 1, F.lit(PART)))
    start = F.struct(before.alias("s"), F.array().cast(f"array<array<{_OUTCOME}>>").alias("out")).cast(f"struct<s: {STATE}, out: array<array<{_OUTCOME}>>>")
    string = lambda a, cs: _let(part(a["s"], cs), lambda r: F.struct(r["s"].alias("s"), F.array_append(a["out"], r["out"]).alias("out")))
    return F.aggregate(parts, start, string, lambda a: F.flatten(a["out"]))


def play(commands: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Apply each session's commands in order (``at``, then ``seq``).

    Input: ``session_code, seq, at, command, player_id, game_id, region,
    max_players, min_players_to_start``.  Returns a row per command: whether it
    was accepted, why not, the event that it makes, and the session after it.
    Commands that agree in time and number are taken in the order of their other fields.

    A session is a fold over its sorted commands in built-in functions; sessions run side by side.
    Of a session with more than ``chunk`` commands one chunk is folded at a time, and its last state
    carried on to the next; the chunks of all long sessions take turns together.
    """
    fields = ("at", "seq", "command", "player_id", "game_id", "region", "max_players", "min_players_to_start")
    rows = commands.select("session_code", F.col("at").cast("timestamp_ntz").alias("at"), *fields[1:])
    longest = rows.groupBy("session_code").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    start = F.lit(None).cast(STATE)
    gathered = F.sort_array(F.collect_list(F.struct(*fields))).alias("commands")
    if longest <= chunk:
        return _outcomes(rows.groupBy("session_code").agg(gathered).select("session_code", F.explode(_folded(F.col("commands"), start)).alias("o")))
    ranked = settled(group_rank(rows, ["session_code"], list(fields), "place").withColumn("chunk", F.floor((F.col("place") - 1) / chunk)))
    done: list[DataFrame] = []
    carried = None
    for k in range(-(-longest // chunk)):
        turn = ranked.where(F.col("chunk") == k).groupBy("session_code").agg(gathered)
        if carried is not None:
            turn = turn.join(carried, turn["session_code"].eqNullSafe(carried["of"]), "left").select(turn["session_code"], "commands", "before")
        out = settled(turn.select("session_code", _folded(F.col("commands"), start if carried is None else F.col("before")).alias("out")))
        # Only sessions with a whole chunk behind them can have another.
        carried = out.where(F.size("out") == chunk).select(F.col("session_code").alias("of"), F.element_at("out", -1)["s"].alias("before"))
        done.append(out.select("session_code", F.explode("out").alias("o")))
    return _outcomes(reduce(DataFrame.unionAll, done))


def _outcomes(rows: DataFrame) -> DataFrame:
    o, s = F.col("o"), F.col("o")["s"]
    event = F.when(o["reason"].isNull(), F.element_at(F.create_map(*[F.lit(x) for kv in COMMANDS.items() for x in kv]), o["command"]))
    uptime = F.expr("(unix_micros(CAST(o.at AS TIMESTAMP)) - unix_micros(CAST(o.s.created_at AS TIMESTAMP))) DIV 1000000")
    return rows.select(
        "session_code", o["seq"].alias("seq"), o["at"].alias("at"), o["command"].alias("command"), o["player_id"].alias("player_id"), o["reason"].isNull().alias("accepted"),
        o["reason"].alias("reason"), event.alias("event_type"), s["game_id"].alias("game_id"), s["region"].alias("region"), s["state"].alias("state"),
        s["host_player_id"].alias("host_player_id"), s["players"].alias("players"), F.when(s["state"].isNotNull(), F.size(s["players"])).alias("player_count"),
        s["max_players"].alias("max_players"), s["min_players_to_start"].alias("min_players_to_start"), (F.size(s["players"]) >= s["max_players"]).alias("is_full"),
        uptime.alias("uptime_seconds"), s["created_at"].alias("created_at"), s["updated_at"].alias("updated_at"), s["expires_at"].alias("expires_at"),
    )


def latest(outcomes: DataFrame) -> DataFrame:
    """Each session as it is now."""
    fields = ("game_id", "region", "state", "host_player_id", "players", "player_count", "max_players", "min_players_to_start", "is_full", "created_at", "updated_at", "expires_at")
    last = F.max_by(F.struct(*fields), F.struct("at", "seq"))
    return outcomes.where("accepted").groupBy("session_code").agg(last.alias("s")).select("session_code", "s.*")


def by_code(sessions: DataFrame, code: str) -> DataFrame:
    return sessions.where(F.col("session_code") == code)


def in_states(sessions: DataFrame, *states: str) -> DataFrame:
    return sessions.where(F.col("state").isin(*states))


def in_place(sessions: DataFrame, game_id: str, region: str, *states: str) -> DataFrame:
    return in_states(sessions, *states).where((F.col("game_id") == game_id) & (F.col("region") == region))


def open_sessions(sessions: DataFrame, game_id: str, region: str, states: tuple[str, ...] = ("WAITING", "ACTIVE")) -> DataFrame:
    """Sessions that are listed to players; those about to start are not, unless asked for."""
    return in_place(sessions, game_id, region, *states)


def has_player(player_id: str) -> Column:
    return F.coalesce(F.exists("players", lambda p: p == player_id), F.lit(False))


def of_player(sessions: DataFrame, player_id: str, states: tuple[str, ...] = LIVE_STATES) -> DataFrame:
    """A player's live sessions."""
    return in_states(sessions, *states).where(has_player(player_id))


def count_by_game(sessions: DataFrame, state: str) -> DataFrame:
    return in_states(sessions, state).groupBy("game_id").agg(F.count(F.lit(1)).alias("sessions"))


def gauges(sessions: DataFrame) -> DataFrame:
    """Live sessions and the players in them."""
    live = in_states(sessions, *LIVE_STATES)
    return live.agg(F.count(F.lit(1)).alias("live_sessions"), F.coalesce(F.sum(player_total(F.col("players"))), F.lit(0)).cast("long").alias("connected_players"))


def party_sessions(members: DataFrame) -> DataFrame:
    """The commands that turn parties into sessions: the anchor creates, the others join in order.

    ``members`` has ``game_id, region, party, seat, player_id`` and ``at``.
    """
    size = F.max("seat").over(Window.partitionBy("game_id", "region", "party"))
    code = F.upper(F.substring(F.sha2(F.concat_ws("/", "game_id", "region", F.col("party").cast("string"), F.col("at").cast("string")), 256), 1, 8))
    return members.select(
        code.alias("session_code"),
        F.col("seat").cast("long").alias("seq"),
        "at",
        F.when(F.col("seat") == 1, "create").otherwise("join").alias("command"),
        "player_id",
        "game_id",
        "region",
        F.greatest(size, F.lit(2)).cast("int").alias("max_players"),
        F.lit(LEAST_PLAYERS).alias("min_players_to_start"),
    )

