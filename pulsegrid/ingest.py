"""Command: offline corpora into tables. ``python -m pulsegrid.ingest --base DIR --out DIR [--full]``."""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import tables
from .session import get_session
from .sources import corpora

#: Rows of each table that are taken without --full.
LIMITS = {"tweets": 5000, "users": 5000, "cascades": 5000, "edges": 10_000}
#: Files below the base folder, by table.
FILES = {
    "train_users": "training_set_users.txt", "test_users": "test_set_users.txt", "tweets": "training_set_tweets.txt",
    "map_users": "distinct_users_from_search_table_real_map.csv", "cascades": "Cascade.zip", "edges": "link.zip",
}


def options(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="pulsegrid.ingest", description=__doc__)
    p.add_argument("--base", required=True, help="folder of the corpora")
    p.add_argument("--out", required=True, help="folder of the tables, Parquet")
    p.add_argument("--full", action="store_true", help="take all rows")
    p.add_argument("--partition-mb", type=int, default=64, help="input bytes of a task")
    for name, n in LIMITS.items():
        p.add_argument(f"--{name}-limit", type=int, default=n)
    return p.parse_args(args)


def sources(spark: SparkSession, base: str, limits: dict[str, int | None]) -> dict[str, Callable[[], DataFrame]]:
    """Table name to what gives its rows."""
    at = {k: f"{base}/{f}" for k, f in FILES.items()}
    cut = lambda df, name: df.limit(limits[name]) if limits[name] else df

    def users() -> DataFrame:
        train = corpora.tsv_users(spark, at["train_users"], "train", limits["users"])
        test = corpora.tsv_users(spark, at["test_users"], "test", limits["users"])
        mapped = corpora.csv_users(spark, at["map_users"], limits["users"])
        return train.unionByName(test).unionByName(mapped, allowMissingColumns=True)

    def cascades() -> DataFrame:
        rows = corpora.cascades(corpora.zipped_lines(spark, at["cascades"])).filter(~F.col("rejected")).drop("rejected")
        return cut(rows.withColumn("post_id", F.concat_ws("_", "cascade_id", "user_id")), "cascades")

    return {
        "users": users,
        "posts": lambda: corpora.tsv_posts(spark, at["tweets"], limit=limits["tweets"]),
        "cascade_events": cascades,
        "graph_edges": lambda: cut(corpora.dump_edges(corpora.zipped_lines(spark, at["edges"])), "edges"),
    }


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Writes each table with one row for each key; a table that can't be read is reported and leaves the others be."""
    start = time.time()
    limits = {k: None if args.full else getattr(args, f"{k}_limit") or None for k in LIMITS}
    spark.conf.set("spark.sql.files.maxPartitionBytes", f"{args.partition_mb}m")
    done, failed = {}, {}
    for name, read in sources(spark, args.base.rstrip("/"), limits).items():
        try:
            rows = read()
            keyed = tables.upsert(rows.limit(0), rows, tables.KEYS[name])
            keyed.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{name}")
            done[name] = spark.read.parquet(f"{args.out.rstrip('/')}/{name}").count()
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:300]
    return {"rows": done, "failed": failed, "seconds": round(time.time() - start, 1)}


def main(args: list[str] | None = None) -> int:
    chosen = options(args)
    summary = run(get_session("pulsegrid-ingest"), chosen)
    print(json.dumps(summary))
    return 1 if summary["failed"] else 0


if __name__ == "__main__":
    sys.exit(main())
