"""The session state machine as a class that takes one command at a time, to hold the fold against."""

from datetime import timedelta

from tidewell.functions.contract import JOINABLE_STATES
from tidewell.operators.sessions import COMMANDS, LEAST_PLAYERS, MOST_PLAYERS

WAITING_LIFE, ACTIVE_LIFE = timedelta(hours=2), timedelta(hours=6)


class Session:
    """One session's state; every method is a command and raises ValueError if it is refused."""

    def __init__(self, at, player: str, game: str | None, region: str | None, most: int | None, least: int | None):
        self.game, self.region = game, region
        self.most, self.least = most or MOST_PLAYERS, least or LEAST_PLAYERS
        self.state, self.host, self.players = "WAITING", player, [player]
        self.created = self.updated = at
        self.expires = at + WAITING_LIFE

    def join(self, at, player: str) -> None:
        if self.state not in JOINABLE_STATES:
            raise ValueError(f"not joinable in state {self.state}")
        if len(self.players) >= self.most:
            raise ValueError("full")
        if player in self.players:
            raise ValueError("already joined")
        self.players.append(player)
        if self.state == "WAITING" and len(self.players) >= self.least:
            self.state = "STARTING"
        self.updated = at

    def leave(self, at, player: str) -> None:
        if player not in self.players:
            raise ValueError("not in the session")
        self.players.remove(player)
        if not self.players:
            self.state = "TERMINATED"
        else:
            if self.host == player:
                self.host = self.players[0]
            if self.state == "STARTING" and len(self.players) < self.least:
                self.state = "WAITING"
        self.updated = at

    def _by_host(self, player: str) -> None:
        if player != self.host:
            raise ValueError("only the host can do this")

    def start(self, at, player: str) -> None:
        self._by_host(player)
        if len(self.players) < self.least:
            raise ValueError(f"needs {self.least} players to start")
        self.state, self.updated, self.expires = "ACTIVE", at, at + ACTIVE_LIFE

    def terminate(self, at, player: str) -> None:
        self._by_host(player)
        self.state, self.updated = "TERMINATED", at


def _applied(s: Session | None, r: dict) -> tuple[Session | None, str | None]:
    """The session after a command, and why the command was refused if it was."""
    command, at, player = r["command"], r["at"], r["player_id"]
    if command not in COMMANDS:
        return s, "unknown command"
    if command == "create":
        if s is not None:
            return s, "exists already"
        return Session(at, player, r["game_id"], r["region"], r["max_players"], r["min_players_to_start"]), None
    if s is None:
        return s, "no such session"
    try:
        getattr(s, command)(at, player)
    except ValueError as e:
        return s, str(e)
    return s, None


def _outcome(s: Session | None, r: dict, reason: str | None) -> dict:
    out = {k: r[k] for k in ("session_code", "seq", "at", "command", "player_id")}
    out |= {"accepted": reason is None, "reason": reason, "event_type": COMMANDS[r["command"]] if reason is None else None}
    if s is not None:
        n = len(s.players)
        out |= {"game_id": s.game, "region": s.region, "state": s.state, "host_player_id": s.host, "players": list(s.players), "player_count": n}
        out |= {"max_players": s.most, "min_players_to_start": s.least, "is_full": n >= s.most, "uptime_seconds": int((r["at"] - s.created).total_seconds())}
        out |= {"created_at": s.created, "updated_at": s.updated, "expires_at": s.expires}
    return out
