"""Commands: build, census, renames, crosscheck, demo, figure, case."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import figures
from .config import Config
from .operators import crosscheck, facts, renames, revisions, stats, vintage
from .sources import archive, companyfacts, observations
from .sources.download import download

log = logging.getLogger("tideline")


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file in a folder."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table, read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build(spark: SparkSession, config: Config, args: argparse.Namespace) -> None:
    if not args.offline:
        download(config)
    rows = [{"quarter": q, **counts} for q, counts in archive.build(spark, config, config.quarters).items()]
    config.out_dir.mkdir(parents=True, exist_ok=True)
    write_csv(spark.createDataFrame(rows), config.table("out", "filter_counts"))
    obs = observations.load(spark, config)
    facts.assert_primary_key(obs)
    report = facts.summary(obs).first().asDict() | facts.business_keys(obs).first().asDict() | {"by_form": {r["form"]: r["n_rows"] for r in facts.by_form(obs).collect()}}
    (config.out_dir / "summary.json").write_text(json.dumps(report, default=str, indent=1))


def census(spark: SparkSession, config: Config, args: argparse.Namespace, tag_map: DataFrame | None = None, suffix: str = "") -> None:
    obs = observations.load(spark, config)
    events_ = written(revisions.events(obs, tag_map), config.table("out", f"revisions{suffix}"))
    census_ = written(revisions.census(obs, config, tag_map), config.table("out", f"census{suffix}"))
    for name, table in stats.compute(obs, census_, events_).items():
        write_csv(table, config.table("out", f"stats_{name}{suffix}"))


def renames_(spark: SparkSession, config: Config, args: argparse.Namespace) -> None:
    obs = observations.load(spark, config)
    found = written(renames.detect(obs), config.table("out", "rename_candidates"))
    write_csv(found.orderBy("accepted", "exact_agreement", ascending=False), config.table("out", "tag_renames"))
    tag_map = renames.class_table(found)
    log.info("contradictions after merging: %s", revisions.merged_conflicts(obs, tag_map).first()["n_conflicts"])
    census(spark, config, args, tag_map, "_canonical")


def crosscheck_(spark: SparkSession, config: Config, args: argparse.Namespace) -> None:
    obs = observations.load(spark, config)
    ciks = crosscheck.sample_companies(obs, args.n_ciks, args.seed)
    ours = obs.join(ciks, "cik", "left_semi")
    if not args.offline:
        companyfacts.fetch(spark, config, [r["cik"] for r in ciks.collect()])  # as many as were asked for
    theirs = companyfacts.flattened(companyfacts.read(spark, companyfacts.folder(config))).join(ciks, "cik", "left_semi")
    report = crosscheck.summary(ours, theirs).first().asDict() | {"seed": args.seed, "n_ciks_sampled": ciks.count()}
    (config.out_dir / "crosscheck_summary.json").write_text(json.dumps(report, indent=1))
    write_csv(crosscheck.conflicts(ours, theirs).orderBy(*crosscheck.MATCH_KEY).limit(5000), config.table("out", "crosscheck_conflicts"))


def demo(spark: SparkSession, config: Config, args: argparse.Namespace) -> None:
    obs = observations.load(spark, config, tags=[t for t, _ in vintage.ITEMS.values()])
    runs = written(vintage.runs(obs, config.as_of_dates, config.truncation_points, config.universe_size), config.table("out", "demo_runs"))
    panel = written(vintage.panel_of_runs(runs), config.table("out", "demo_panel"))
    cut = vintage.truncation_of_runs(runs, config.as_of_dates, config.truncation_points)
    write_csv(vintage.verdicts(vintage.lambdas(panel, config.lambda_tol), cut), config.table("out", "demo_lambda"))


def figure(spark: SparkSession, config: Config, args: argparse.Namespace) -> None:
    read = {n: spark.read.parquet(config.table("out", n)) for n in ("census", "revisions", "demo_panel")}
    verdicts = spark.read.csv(config.table("out", "demo_lambda"), header=True, inferSchema=True)
    figures.build_all(figures.census_data(read["census"], read["revisions"], args.censoring), figures.vintage_data(verdicts, vintage.lambda_by_date(read["demo_panel"], config.lambda_tol)), config.figures_dir)


def case(spark: SparkSession, config: Config, args: argparse.Namespace) -> None:
    """A fact that is known to have been rewritten, as the second source tells it; fails unless it shows both values."""
    if not args.offline:
        companyfacts.fetch(spark, config, [args.cik])
    documents = companyfacts.read(spark, companyfacts.folder(config))
    told = companyfacts.series(documents, args.cik, args.tag, args.uom, dt.date.fromisoformat(args.end), dt.date.fromisoformat(args.start) if args.start else None)
    report = companyfacts.known_case(told, args.first, args.final).first().asDict()
    (config.out_dir / "known_case.json").write_text(json.dumps(report, indent=1))
    if not report["holds"]:
        raise SystemExit(f"company {args.cik}, {args.tag}: {report}")


COMMANDS = {"build": build, "census": census, "renames": renames_, "crosscheck": crosscheck_, "demo": demo, "figure": figure, "case": case}


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--quarters", default=argparse.SUPPRESS, help="2023q1,2023q2,...; all of them by default")
    shared.add_argument("--root", default=argparse.SUPPRESS)
    shared.add_argument("-v", "--verbose", action="store_true", default=argparse.SUPPRESS)
    top = argparse.ArgumentParser(prog="tideline", parents=[shared])
    commands = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        sub = commands.add_parser(name, parents=[shared])
        if name in ("build", "crosscheck", "case"):
            sub.add_argument("--offline", action="store_true", help="use the files that are there")
        if name == "crosscheck":
            sub.add_argument("--n-ciks", type=int, default=100)
            sub.add_argument("--seed", type=int, default=0)
        if name == "case":
            sub.add_argument("--cik", type=int, required=True)
            for option in ("--tag", "--uom", "--end"):
                sub.add_argument(option, required=True)
            sub.add_argument("--start")
            sub.add_argument("--first", type=float, required=True)
            sub.add_argument("--final", type=float, required=True)
        if name == "figure":
            sub.add_argument("--censoring", choices=stats.GROUPS, default="all")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if getattr(args, "verbose", False) else logging.INFO)
    root = getattr(args, "root", ".")
    config = Config.of(args.quarters, root) if hasattr(args, "quarters") else Config(root=root)
    session = spark or SparkSession.builder.appName("tideline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config.out_dir.mkdir(parents=True, exist_ok=True)
    COMMANDS[args.command](session, config, args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
