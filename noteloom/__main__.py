"""python -m noteloom COMMAND: index, sync, watch, search, answer, status, rebuild, compact."""

from __future__ import annotations

import argparse
import sys

from noteloom.sources.corpus import Config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="noteloom")
    p.add_argument("command", choices=["index", "sync", "watch", "search", "answer", "status", "rebuild", "compact"])
    p.add_argument("text", nargs="*", help="the query or question")
    p.add_argument("--root", action="append", dest="roots")
    p.add_argument("--store")
    p.add_argument("--config")
    p.add_argument("--limit", type=int)
    p.add_argument("--tag", action="append", dest="tags")
    p.add_argument("--force", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config = Config.resolve(Config(roots=args.roots, store=args.store, limit=args.limit), args.config)
    if not config.store:
        print("name a store: --store, or in the configuration", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from noteloom.engine import Engine

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    reads = args.command in ("search", "answer", "status")
    engine = Engine(spark, config.store, config, read_only=reads)
    try:
        if args.command in ("index", "sync"):
            print(engine.sync(args.force or args.command == "index"))
            print(engine.process_queues())
        elif args.command == "rebuild":
            print(engine.rebuild(), engine.process_queues())
        elif args.command == "compact":
            engine.compact()
        elif args.command == "status":
            for key, value in engine.diagnostics().items():
                print(f"{key}: {value}")
        elif args.command == "search":
            found = engine.search(" ".join(args.text), tags=args.tags)
            for r in found.results.toLocalIterator():
                print(f"{r.score:.4f}  {r.citation}\n    {' '.join(r.content.split())[:240]}")
            print(*found.degradations, sep="\n")
        elif args.command == "answer":
            got = engine.answer(" ".join(args.text))
            print(got.text, *got.citations, sep="\n")
        else:
            import time

            while True:  # what changed is found by the diff, so a poll is as good as an event
                print(engine.sync(), engine.process_queues(), flush=True)
                time.sleep(5)
    finally:
        engine.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
