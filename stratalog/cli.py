"""Command line over a segment table: ``python -m stratalog.cli TABLE COMMAND ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import moves, scans, shards
from .sources.segments import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratalog")
    p.add_argument("table", help="path of the table, in any store that Spark reaches")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"get": ["key"], "put": ["key", "value"], "delete": ["key"], "cas": ["key", "value"], "scan": [], "shards": [], "compact": [], "vacuum": [], "stats": [], "export": ["path"], "restore": ["path"], "map": [], "move": ["shard", "group"]}.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        if name in ("get", "scan", "export"):
            s.add_argument("--as-of", type=int)
        if name == "cas":
            s.add_argument("--expected", help="current value; without it the key must be absent")
        if name == "scan":
            s.add_argument("--start")
            s.add_argument("--end")
            s.add_argument("--limit", type=int, default=0)
            s.add_argument("--max-bytes", type=int, default=0)
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """Lines of output."""
    if args.command in ("map", "move"):  # of the logs of several groups
        groups = moves.Groups(spark, args.table)
        if args.command == "move":
            return groups.move(int(args.shard), int(args.group))
        return [f"{s}\t{g}" + (f"\tmoving to {to}" if to else "") for s, (g, to) in sorted(groups.map().items())]
    store = Store(spark, args.table)
    if args.command == "get":
        return [r.value for r in store.get(args.key, args.as_of).collect()] or ["not found"]
    if args.command == "put":
        return [f"seq {store.put(args.key, args.value).max_seq}"]
    if args.command == "delete":
        return [f"seq {store.delete(args.key).max_seq}"]
    if args.command == "cas":
        done, found = store.cas(args.key, args.value, args.expected)
        return [f"success {str(done).lower()}", *([] if found is None else [f"found {found}"])]
    if args.command == "scan":
        pairs = store.scan(args.start, args.end, args.as_of)
        return [f"{r.key}\t{r.value}" for r in scans.bounded(pairs, args.limit, args.max_bytes).collect()]
    if args.command == "shards":
        return [f"{r.shard}\t{r.n}" for r in shards.histogram(store.scan()).orderBy(F.col("shard")).collect()]
    if args.command == "compact":
        return [f"segments {len(store.compact().segments)}"]
    if args.command == "vacuum":
        return store.vacuum()
    if args.command == "export":
        store.export(args.path, args.as_of)
        return []
    if args.command == "restore":
        return [f"seq {store.restore(args.path).max_seq}"]
    return [f"{k}\t{v}" for k, v in store.stats().items()]


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("stratalog").getOrCreate()
    print("\n".join(run(spark, args)))
    spark.stop()


if __name__ == "__main__":
    main()
