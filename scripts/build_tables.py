"""Build silver, dimension and gold tables into a folder.

usage: python scripts/build_tables.py OUT_DIR [--sf SF_DIR | --raw RAW_DIR] [--master local[8]]

On a cluster run it through spark-submit without --master; the session's
settings (spark.checkpoint.dir, shuffle partitions) are used as given.
"""

from __future__ import annotations

import argparse
import sys

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from pyspark.sql import SparkSession  # noqa: E402

from coursemetrics.plans.medallion import build_tables  # noqa: E402
from coursemetrics.session import build_session, configure  # noqa: E402


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("out")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--sf", help="folder with the driver's parquet tables")
    src.add_argument("--raw", help="folder with xapi_events.json, courses.json, learners.json")
    ap.add_argument("--master", default=None)
    a = ap.parse_args()
    spark = build_session(a.master) if a.master else configure(SparkSession.builder.getOrCreate())
    for name, path in build_tables(spark, a.out, sf_dir=a.sf, raw_dir=a.raw).items():
        print(f"{name:26s} {spark.read.parquet(path).count():>10,}  {path}")


if __name__ == "__main__":
    main()
