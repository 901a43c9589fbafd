"""``python -m tidewell.cli run|bronze|silver|gold|compact|query|history|generate``."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime, timedelta

from tidewell.operators.generate import SEED, land
from tidewell.options import BRONZE, SILVER, Drive, LakeOptions
from tidewell.plans.catalog import layout_queries, rendered, run_pack
from tidewell.plans.compaction import measure
from tidewell.sources.events import EventSource, FileEventSource, KafkaEventSource
from tidewell.sources.table import LakeTable
from tidewell.streaming import bronze, gold, medallion, silver

VERBS = ("run", "bronze", "silver", "gold", "compact", "query", "history", "generate")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewell", description=__doc__)
    p.add_argument("verb", choices=VERBS)
    p.add_argument("--base-path", default="data/lakehouse")
    p.add_argument("--source", choices=("kafka", "file"), default="kafka")
    p.add_argument("--kafka", default="localhost:9092")
    p.add_argument("--topic", default="session-events")
    p.add_argument("--starting-offsets", default="earliest")
    p.add_argument("--shuffle-partitions", type=int, default=8)
    p.add_argument("--max-files-per-trigger", type=int, default=200)
    p.add_argument("--rate-limited", action="store_true")
    p.add_argument("--continuous", action="store_true")
    p.add_argument("--interval-seconds", type=float, default=10)
    p.add_argument("--master")
    p.add_argument("--table", help="the table to compact; silver if not given")
    p.add_argument("--iterations", type=int, default=7)
    p.add_argument("--warmups", type=int, default=2)
    p.add_argument("--vacuum", action="store_true")
    p.add_argument("--sessions", type=int, default=1000, help="sessions to generate into the landing folder")
    p.add_argument("--files", type=int, default=20)
    p.add_argument("--spread-minutes", type=float, default=10)
    p.add_argument("--seed", type=int, default=SEED)
    return p


def options_of(a: argparse.Namespace) -> LakeOptions:
    drive = Drive.CONTINUOUS if a.continuous else Drive.RATE_LIMITED if a.rate_limited else Drive.AVAILABLE_NOW
    return LakeOptions(
        base=a.base_path,
        drive=drive,
        interval=timedelta(seconds=a.interval_seconds),
        max_files=a.max_files_per_trigger,
        shuffle_partitions=a.shuffle_partitions,
        master=a.master,
        kafka_servers=a.kafka,
        kafka_topic=a.topic,
        starting_offsets=a.starting_offsets,
    )


def source_of(a: argparse.Namespace, options: LakeOptions) -> EventSource:
    return FileEventSource(options) if a.source == "file" else KafkaEventSource(options)


def compact(spark, options: LakeOptions, a: argparse.Namespace) -> None:
    table = LakeTable(spark, a.table or options.table(SILVER))
    sample = table.read().select("session_code").limit(1).collect() if table.exists() else []
    if not sample:
        print(f"nothing to compact in {table.path}")
        return
    report = measure(spark, table, layout_queries(sample[0][0]), ("game_id", "session_code"), a.warmups, a.iterations)
    print(report.markdown())
    report.save(spark, options)
    if a.vacuum:
        print(f"{table.vacuum(0)} superseded files deleted")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    options = options_of(a)
    spark = options.session(f"tidewell-{a.verb}")
    if a.verb == "run":
        source = source_of(a, options)
        print(f"bronze from {source.describe()}")
        medallion.run_all(spark, options, source)
        for name, rows in medallion.row_counts(spark, options).items():
            print(f"  {name:28s} {rows:,} rows")
    elif a.verb == "bronze":
        bronze.run(spark, options, source_of(a, options))
    elif a.verb == "silver":
        silver.run(spark, options)
    elif a.verb == "gold":
        gold.run(spark, options)
    elif a.verb == "compact":
        compact(spark, options, a)
    elif a.verb == "generate":
        spread = timedelta(minutes=a.spread_minutes)
        land(spark, options.landing, a.sessions, a.files, datetime.now(UTC) - spread, int(spread.total_seconds()), a.seed)
        print(f"{a.sessions} sessions in {options.landing}")
    elif a.verb == "query":
        print("\n".join(run_pack(spark, options)))
    else:
        for name in (BRONZE, SILVER):
            table = LakeTable(spark, options.table(name))
            if table.exists():
                print(name, rendered(table.history(20)), sep="\n")


if __name__ == "__main__":
    main()
