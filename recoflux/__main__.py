"""Command line: jobs and recommendations over the bundled tables.

    python -m recoflux JOB --data DIR [--out DIR] [--config FILE] ...
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from recoflux import config as settings
from recoflux import schema
from recoflux.engine import Engine
from recoflux.operators import abtest, merging
from recoflux.sources import scans, sinks, testdata

JOBS = ("summarize_activities", "summarize_impressions", "summarize_popularities", "generate_user_templates", "generate_product_templates", "generate_product_templates_tfidf", "process_products")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recoflux", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="job", required=True)

    def add(name: str, *options: tuple) -> None:
        q = sub.add_parser(name)
        for flags, more in options:
            q.add_argument(flags, **more)

    data = [("--data", {"required": True}), ("--out", {}), ("--config", {})]
    for job in JOBS:
        add(job, *data)
    add("recommend", *data, ("--users", {"nargs": "*"}), ("--n", {"type": int, "default": 10}), ("--algorithm", {"default": "HRVoting"}), ("--filter", {}))
    add("batch_recommend", *data, ("--csv", {}), ("--n", {"type": int, "default": 10}), ("--algorithm", {"default": "HRVoting"}))
    add("calculate_tf", ("--language", {"required": True}), ("--text", {"required": True}))
    add("merge", ("--numerators", {"required": True}), ("--denominators", {"required": True}), ("--strengths", {"required": True}), ("--out", {"required": True}), ("--header", {"action": "store_true"}))
    ab = [("--sessions", {"type": int, "required": True}), ("--buys", {"type": int, "required": True}), ("--share", {"type": float, "default": 1.0})]
    add("ab_days", *ab, ("--gain", {"type": float, "required": True}), ("--accepted", {"type": float, "required": True}), ("--reliability", {"type": float, "required": True}))
    add("ab_gain", *ab, ("--days", {"type": int, "required": True}), ("--reported", {"type": float, "required": True}))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"recoflux {a.job}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.job == "merge":
        parts = [scans.csv(spark, path, kind, a.header) for path, kind in ((a.numerators, schema.CSV_NUMERATORS), (a.denominators, schema.CSV_DENOMINATORS), (a.strengths, schema.CSV_STRENGTHS))]
        sinks.write_csv(merging.merge_operands(*parts), a.out)
        return
    if a.job == "ab_days":
        print(abtest.needed_days(spark, a.sessions, a.buys, a.share, a.gain, a.accepted, a.reliability))
        return
    if a.job == "ab_gain":
        abtest.gain_posterior(spark, a.sessions, a.buys, a.days, a.share, a.reported).orderBy("actual").show(200, False)
        return
    if a.job == "calculate_tf":
        Engine(spark, settings.EngineConfig(), *[spark.createDataFrame([], k) for k in (schema.ACTIVITIES, schema.IMPRESSIONS)], None).calculate_tf(a.language, a.text).orderBy(F.desc("count"), "term").show(1000, False)
        return
    config = settings.load(a.config) if a.config else settings.EngineConfig()
    store = sinks.Store(spark, a.out) if a.out else None
    engine = Engine(spark, config, testdata.activities(spark, a.data), testdata.impressions(spark, a.data), testdata.products(spark, a.data), testdata.users(spark, a.data), store)
    if a.job == "recommend":
        engine.recommend(a.users, a.n, a.algorithm, a.filter).orderBy("user", "rank").show(1000, False)
    elif a.job == "batch_recommend":
        rows = engine.batch_recommend(a.n, a.algorithm)
        sinks.write_csv(rows, a.csv) if a.csv else rows.show(1000, False)
    else:
        getattr(engine, a.job)()


if __name__ == "__main__":
    main()
