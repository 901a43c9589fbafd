"""Settings of a lakehouse: where tables lie, how streams are driven, Spark settings."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta
from enum import Enum

from pyspark.sql import SparkSession

#: Tables of the lakehouse by layer; the names are part of the data contract.
TABLES = (
    "bronze_session_events",
    "silver_session_events",
    "silver_quarantine",
    "gold_session_lifecycle_1m",
    "gold_region_concurrency_1m",
    "gold_session_duration",
    "gold_matchmaking_funnel",
)
BRONZE, SILVER, QUARANTINE, LIFECYCLE, CONCURRENCY, DURATION, FUNNEL = TABLES


class Drive(Enum):
    """How streaming queries are driven."""

    #: Take what is there as one batch of the source's choosing, then stop.
    AVAILABLE_NOW = "available-now"
    #: Take what is there in batches of at most ``max_files``, then stop.
    RATE_LIMITED = "rate-limited"
    #: Run until stopped, a batch per interval.
    CONTINUOUS = "continuous"


@dataclass(frozen=True)
class LakeOptions:
    """All settings with their defaults."""

    base: str = "data/lakehouse"
    drive: Drive = Drive.AVAILABLE_NOW
    interval: timedelta = timedelta(seconds=10)
    window: timedelta = timedelta(minutes=1)
    max_files: int = 200
    shuffle_partitions: int = 8
    master: str | None = None
    kafka_servers: str = "localhost:9092"
    kafka_topic: str = "session-events"
    starting_offsets: str = "earliest"

    def table(self, name: str) -> str:
        """The folder of a table."""
        if name not in TABLES:
            raise ValueError(f"no table {name!r}")
        return f"{self.base}/tables/{name}"

    @property
    def landing(self) -> str:
        """Where the file source looks for event files."""
        return f"{self.base}/landing"

    def checkpoint(self, query: str) -> str:
        """The checkpoint folder of a streaming query."""
        return f"{self.base}/_checkpoints/{query}"

    @property
    def reports(self) -> str:
        return f"{self.base}/_benchmarks"

    @property
    def window_text(self) -> str:
        """The tumbling window as Spark writes intervals; seconds are kept."""
        seconds = int(self.window.total_seconds())
        if seconds <= 0:
            raise ValueError("the window must be at least a second long")
        return f"{seconds} seconds"

    def spark_conf(self) -> dict[str, str]:
        """Settings that all jobs share.  Broadcast limits and memory stay the cluster's."""
        return {
            "spark.sql.shuffle.partitions": str(self.shuffle_partitions),
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.sources.partitionOverwriteMode": "dynamic",
            "spark.ui.showConsoleProgress": "false",
        }

    def session(self, app: str) -> SparkSession:
        """A session with these settings."""
        builder = SparkSession.builder.appName(app).config(map=self.spark_conf())
        if self.master:
            builder = builder.master(self.master)
        return builder.getOrCreate()
