"""Command line: ``spark-submit`` or ``python -m renewlens`` with the four feeds and a folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from renewlens.plans import job, session
from renewlens.plans.warehouse import Landing


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="renewlens", description=__doc__)
    for feed in ("users", "subscriptions", "payments", "listening"):
        parser.add_argument(f"--{feed}", required=True, help=f"path of the {feed} CSV files")
    parser.add_argument("--out", required=True, help="folder for all results")
    parser.add_argument("--as-of", help="reference day, YYYY-MM-DD; today in UTC if left out")
    parser.add_argument("--strict", action="store_true", help="fail on the first malformed row")
    parser.add_argument("--overwrite", action="store_true", help="replace earlier results")
    parser.add_argument(
        "--by-position", action="store_true", help="take columns by position, not by header"
    )
    parser.add_argument("--report", action="append", help="only this report; may be repeated")
    chosen = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("renewlens").getOrCreate()
    paths = [chosen.users, chosen.subscriptions, chosen.payments, chosen.listening]
    size = session.input_size(spark, paths)
    session.apply(spark, session.sized(spark, size))
    landing = Landing.from_csv(
        spark,
        users=chosen.users,
        subscriptions=chosen.subscriptions,
        payments=chosen.payments,
        listening=chosen.listening,
        strict=chosen.strict,
        by_name=not chosen.by_position,
    )
    counts = job.run(
        spark,
        landing,
        chosen.out,
        as_of=chosen.as_of,
        strict=chosen.strict,
        reports=chosen.report,
        mode="overwrite" if chosen.overwrite else "errorifexists",
        input_bytes=size,
    )
    for name, found in counts.items():
        print(f"{name}: {found['typed']} typed rows, {found['rejected']} rejected")


if __name__ == "__main__":
    main()
