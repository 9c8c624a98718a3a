"""python -m tarnwater --store FOLDER --status, or --landed FOLDER to crawl what was landed there."""

from __future__ import annotations

import argparse
import signal
import time

from pyspark.sql import SparkSession

from .operators import crawl, metrics
from .operators.store import Store
from .sources.payloads import Landed, current_season

#: The names of the options.
STORE, STATUS, LANDED, WORKERS, BATCH, RESEED = "--store", "--status", "--landed", "--workers", "--batch", "--reseed-interval-hours"


def positive(text):
    n = int(text)
    if n <= 0:
        raise argparse.ArgumentTypeError(f"{n} is not above 0")
    return n


def main(argv=None):
    parser = argparse.ArgumentParser(prog="tarnwater")
    parser.add_argument(STORE, required=True, help="folder of the tables")
    parser.add_argument(STATUS, action="store_true", help="only say where the crawl stands")
    parser.add_argument(LANDED, help="folder of landed responses, to crawl from")
    parser.add_argument(WORKERS, type=positive, default=1)
    parser.add_argument(BATCH, type=positive, default=1000, help="players of a round, for each worker")
    parser.add_argument(RESEED, type=float, default=24.0)
    args = parser.parse_args(argv)
    if not (args.status or args.landed):
        parser.error(f"one of {STATUS} and {LANDED} is needed")
    spark = SparkSession.builder.appName("tarnwater").getOrCreate()
    if args.status:
        print(metrics.progress(Store.readonly(spark, args.store), int(time.time())))
        return
    stopped = []
    before = {s: signal.signal(s, lambda *_: stopped.append(True)) for s in (signal.SIGINT, signal.SIGTERM)}
    try:
        source, store = Landed(spark, args.landed), Store(spark, args.store)
        season = current_season(source.boards()[1])
        crawl.run(store, source, season, lambda: bool(stopped), None, args.reseed_interval_hours * 3600, args.workers, args.batch)
        print(metrics.progress(store, int(time.time())))
    finally:
        for s, f in before.items():
            signal.signal(s, f)


if __name__ == "__main__":
    main()
