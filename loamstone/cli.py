"""Command line: list, stats, verify, diff, prune. Exit codes: 0 done, 1 problems or no store, 2 wrong use."""

from __future__ import annotations

import argparse
import datetime
import sys
import time

from pyspark.sql import functions as F

from loamstone.functions.names import human_age
from loamstone.operators import retention

DEFAULT_STORE = "loamstone-store"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="loamstone", description="Query and maintain a versioned store.")
    commands = out.add_subparsers(dest="command")
    for name in ("list", "stats", "verify", "diff", "prune"):
        p = commands.add_parser(name)
        p.add_argument("--store", default=DEFAULT_STORE)
        if name == "list":
            p.add_argument("--days", type=int, default=0)
        if name == "diff":
            p.add_argument("--older", type=int, required=True)
            p.add_argument("--newer", type=int, required=True)
            p.add_argument("--deep", action="store_true")
        if name == "prune":
            p.add_argument("--days", type=int, default=0)
            p.add_argument("--keep", type=int, default=0)
            p.add_argument("--dry-run", action="store_true")
    commands.add_parser("help")
    return out


def run(argv: list[str], spark=None) -> int:
    own = parser()
    try:
        args = own.parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    if args.command == "help":
        own.print_help()
        return 0
    if not args.command:
        own.print_usage(sys.stderr)
        return 2
    policy = retention.RetentionPolicy(args.days, args.keep) if args.command == "prune" else None
    if policy is not None and policy.is_unbounded:
        print("error: prune needs --days N and/or --keep N (a value below 1 switches a limit off)", file=sys.stderr)
        return 2
    if spark is None:
        from loamstone.session import build_session

        spark = build_session()
    from loamstone.api import Engine

    engine = Engine(spark, args.store)
    if not engine.store.exists():
        print(f"error: no store at {args.store}", file=sys.stderr)
        return 1
    if args.command == "list":
        now = int(time.time())
        found = retention.listing_since(engine.points(), now, args.days).select("ts", human_age(F.lit(now) - F.col("ts")).alias("age"))
        for row in found.toLocalIterator():
            print(f"  {row['ts']}  {datetime.datetime.fromtimestamp(row['ts'], datetime.UTC):%Y-%m-%dT%H:%M:%SZ}  ({row['age']})")
        return 0
    if args.command == "stats":
        for key, value in engine.stats().items():
            print(f"{key}: {value}")
        return 0
    if args.command == "verify":
        n = 0
        for row in engine.verify().toLocalIterator():
            n += 1
            print(f"  {row['place']}: {row['problem']}")
        print(f"problems: {n}" if n else "no problems")
        return 1 if n else 0
    if args.command == "diff":
        found = engine.diff(args.older, args.newer, args.deep)
        print(f"chunks: {found['changed']} changed, {found['only_new']} only in the newer point, {found['only_old']} only in the older point")
        print(f"files: {found['files']} changed")
        return 0
    print(f"pruning what is {policy.describe()}" + " (dry run)" * args.dry_run)
    removed = engine.prune(policy, dry_run=args.dry_run)
    print(f"removed {sum(removed.values())} entries: " + ", ".join(f"{k} {v}" for k, v in removed.items()))
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
