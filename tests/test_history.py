import datetime as dt

from pyspark.sql import functions as F

from tests.conftest import DATA, observation
from tideline.config import Config
from tideline.operators import facts, history, revisions
from tideline.schema import OBSERVATIONS
from tideline.sources import layout
from tideline.streaming import arrivals
from tideline.streaming.current import Current

DAYS = [dt.date(2021, 1, 1), dt.date(2022, 2, 18), dt.date(2022, 3, 4), dt.date(2022, 3, 3), dt.date(2022, 8, 19), dt.date(2030, 1, 1)]


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_views_of_many_days_equal_those_of_each(spark, vintages, make):
    same_day = [observation(91, f"t-{k}", "2022-03-04", v) for k, v in ((2, 8.0), (1, 9.0), (3, None))]
    all_facts = vintages.unionByName(make(same_day)).unionByName(make([observation(92, "u-1", "2022-03-04", 1.0, ddate="2021-12-31")])).cache()
    versions = history.versions(all_facts)
    days = spark.createDataFrame([(d,) for d in [*DAYS, DAYS[2], None]], "asof date")
    many, apart = history.as_of_days(versions, days), history.diff_worlds_days(versions, days)
    for d in DAYS:
        assert rows_of(many.where(F.col("asof") == F.lit(d)).drop("asof")) == rows_of(facts.as_of(all_facts, d)) == rows_of(history.as_of(versions, d)), d
        assert rows_of(apart.where(F.col("asof") == F.lit(d)).drop("asof")) == rows_of(facts.diff_worlds(all_facts, d)), d
    assert {(r["cik"], r["value"]) for r in history.as_of(versions, DAYS[2]).where("cik > 90").collect()} == {(91, None), (92, 1.0)}
    assert history.as_of_days(versions, days.limit(0)).count() == 0 and history.as_of_days(versions.limit(0), days).count() == 0


def test_a_view_of_a_stored_history_opens_few_folders_and_moves_nothing(spark, tmp_path):
    from tideline.plans import catalogue
    from tideline.sources import bridge

    obs = bridge.observations(spark, DATA)
    history.write(history.versions(obs), str(tmp_path / "versions"))
    stored, day = history.read(spark, str(tmp_path / "versions")), dt.date(1998, 6, 30)
    view = history.as_of(stored, day)
    assert rows_of(view) == rows_of(facts.as_of(obs, day))
    opened, there = len(view.inputFiles()), {f for f in stored.inputFiles()}
    assert 0 < opened and len(there) >= 10
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull(from_year" in plan
    used = {r["f"] for r in view.select(F.input_file_name().alias("f")).distinct().collect()}
    assert all(int(f.split("from_year=")[1][:4]) <= 1998 <= int(f.split("to_year=")[1][:4]) for f in used) and len(used) < len(there) / 2
    many = history.as_of_days(stored, spark.createDataFrame([(d,) for d in catalogue.DAYS], "asof date"))
    assert "hashpartitioning(cik" not in many._jdf.queryExecution().executedPlan().toString()


def test_tables_follow_arrivals_and_late_filings(spark, tmp_path, vintages):
    """After each arrival the tables are what the batch operators make of all that came, whatever the order; a batch run twice counts once."""
    config = Config.of("2021q4,2022q1,2022q2,2022q3", tmp_path)
    odd = spark.createDataFrame([observation(cik, f"x-{k}", f, v, period="2021-12-31") for cik, k, f, v in ((71, 9, "2022-03-20", 1.0), (95, 1, "2022-04-01", 5.0), (95, 2, "2022-04-02", None))], OBSERVATIONS)
    undated = odd.where("cik = 95").withColumn("ddate", F.lit(None).cast("date"))
    rows = vintages.select(*OBSERVATIONS.names)
    batches = [rows.where("filed >= '2022-05-01'"), rows.where("filed < '2022-03-01'"), odd, rows.where("filed >= '2022-03-01' and filed < '2022-05-01'"), undated, rows.limit(0)]
    current, so_far = Current(spark, str(tmp_path / "tables"), config), None
    for number, batch in enumerate(batches):
        for _ in range(2 if number in (1, 2) else 1):
            current.update(batch, number)
        so_far = batch if so_far is None else so_far.unionByName(batch)
        assert rows_of(current.table("census")) == rows_of(revisions.census(so_far, config)), number
        assert rows_of(current.table("events")) == rows_of(revisions.events(so_far)), number


def test_a_stream_keeps_the_census(spark, tmp_path, vintages):
    config = Config.of("2021q4,2022q1,2022q2", tmp_path)
    current = Current(spark, str(tmp_path / "tables"), config)
    for part in ("cik <= 72", "cik > 72"):
        vintages.select(*OBSERVATIONS.names).where(part).write.mode("append").parquet(str(tmp_path / "in"))
        current.follow(arrivals.stream(spark, str(tmp_path / "in")), str(tmp_path / "checkpoint")).awaitTermination()
    assert rows_of(current.table("census")) == rows_of(revisions.census(vintages, config))


def test_a_batch_leaves_other_periods_alone(spark, tmp_path):
    config, current = Config.of("2021q4,2022q1", tmp_path), None
    current = Current(spark, str(tmp_path / "tables"), config)
    told = [observation(cik, f"{cik}-{y}", f"{y + 1}-02-01", 1.0, ddate=f"{y}-12-31") for cik in range(40) for y in range(2015, 2022)]
    current.update(spark.createDataFrame(told, OBSERVATIONS), 0)

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "tables" / "census").rglob("*.parquet")}

    before = files()
    current.update(spark.createDataFrame([observation(3, "late", "2023-01-01", 2.0, ddate="2016-12-31")], OBSERVATIONS), 1)
    changed = {p for p, t in files().items() if before.get(p) != t}
    assert changed and all("period_year=2016/part=3" in str(p) for p in changed)
    assert rows_of(current.table("census").where("revised"))[0] and current.table("census").count() == len(told)


def test_bucketed_observations_are_grouped_where_they_lie(spark, tmp_path):
    from tideline.plans import catalogue
    from tideline.sources import bridge

    obs = bridge.observations(spark, DATA)
    layout.write(obs, "bucketed_observations", 4, str(tmp_path / "bucketed"))
    try:
        table = layout.read(spark, "bucketed_observations")
        made = {"latest": facts.latest, "as_of": lambda t: facts.as_of(t, catalogue.AS_OF), "events": revisions.events, "census": lambda t: revisions.census(t, catalogue.CONFIG), "versions": history.versions, "key check": facts.key_violations, "diff": lambda t: facts.diff_worlds(t, catalogue.AS_OF)}
        for name, make_ in made.items():
            assert "Exchange" not in make_(table)._jdf.queryExecution().executedPlan().toString(), name
            assert rows_of(make_(table)) == rows_of(make_(obs)), name
    finally:
        spark.sql("drop table bucketed_observations")
