"""Command line for the lifecycle jobs (use with spark-submit on a cluster):

    python -m aqlens train     CITY_DAY_CSV WEATHER_DOCS OUT_DIR
    python -m aqlens dashboard YEARLY_CSV STATE_CSV PAGES OUT_DIR
    python -m aqlens predict   PAGES FORECAST_DOCS MODEL_DIR OUT_PATH

The session comes from ``getOrCreate`` so cluster settings passed to
spark-submit apply unchanged.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="aqlens")
    sub = ap.add_subparsers(dest="job", required=True)
    t = sub.add_parser("train")
    t.add_argument("city_day_csv")
    t.add_argument("weather_docs")
    t.add_argument("out_dir")
    d = sub.add_parser("dashboard")
    for a in ("yearly_csv", "state_csv", "pages", "out_dir"):
        d.add_argument(a)
    p = sub.add_parser("predict")
    for a in ("pages", "forecast_docs", "model_dir", "out_path"):
        p.add_argument(a)
    args = ap.parse_args(argv)

    from aqlens.plans import jobs

    spark = SparkSession.builder.appName(f"aqlens-{args.job}").getOrCreate()
    if args.job == "train":
        jobs.offline_training(spark, args.city_day_csv, args.weather_docs, args.out_dir).show()
    elif args.job == "dashboard":
        jobs.dashboard(spark, args.yearly_csv, args.state_csv, args.pages, args.out_dir)
    else:
        jobs.predict(spark, args.pages, args.forecast_docs, args.model_dir, args.out_path)


if __name__ == "__main__":
    main()
