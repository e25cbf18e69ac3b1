import datetime as dt
import random

from pyspark.sql import functions as F

from tests.conftest import observation
from tideline.config import Config
from tideline.functions.ranks import nearest_rank, spearman
from tideline.functions.scalar import month_end, qtrs_between
from tideline.operators import revisions, stats

CONFIG = Config.of("2022q1,2022q2,2022q3,2022q4")


def of(df, cik):
    return [r.asDict() for r in df.where(F.col("cik") == cik).orderBy("seq").collect()]


def test_each_change_is_one_event(vintages):
    there, back = of(revisions.events(vintages), 71)
    assert (there["v_old"], there["v_new"], there["seq"], there["lag_days"], there["lag_since_first_days"], there["is_amendment"]) == (640.0, 655.0, 1, 14, 14, True)
    assert (back["v_old"], back["v_new"], back["seq"], back["lag_days"], back["lag_since_first_days"], back["is_amendment"]) == (655.0, 640.0, 2, 90, 265, False)


def test_unit_slips_and_nulls(vintages):
    events = revisions.events(vintages)
    assert [e["scale_exponent"] for e in of(events, 72)] == [-3] and of(events, 74) == []
    ((old, new),) = [(e["v_old"], e["v_new"]) for e in of(events, 73)]
    assert (old, new) == (0.0, 7.0) and events.where("v_old = v_new").count() == 0


def test_census_agrees_with_events(vintages):
    census = {r["cik"]: r for r in revisions.census(vintages, CONFIG).where("revised").collect()}
    assert set(census) == {r["cik"] for r in revisions.events(vintages).select("cik").distinct().collect()} == {71, 72, 73, 83}
    assert (census[71]["n_obs"], census[71]["n_revisions"], census[71]["magnitude"], census[71]["ever_amendment"]) == (4, 1, 0.0, True)
    assert census[72]["ever_scale_change"] and not census[72]["ever_amendment"] and census[73]["from_zero"] and census[73]["n_obs"] == 2


def test_left_censoring(make):
    rows = make(
        [observation(41, "w-1", "2022-02-09", 8.0), observation(42, "w-2", "2022-06-09", 8.0), observation(43, "w-3", "2022-06-09", 8.0, period="2022-03-31"), observation(44, "w-4", "2022-06-09", 8.0, period="2022-01-31")]
    )
    got = {r["cik"]: (r["left_censored_window"], r["first_is_comparative"], r["left_censored"]) for r in revisions.census(rows, CONFIG).collect()}
    assert got == {41: (True, False, True), 42: (False, False, False), 43: (False, True, True), 44: (False, False, False)}


def test_merged_tags(spark, make):
    """Three companies move from one name to another: 51 tells both names alike, 52 contradicts itself, 53 changes the value with the name."""
    told = {51: [("Sales", 9.0), ("Turnover", 9.0)], 52: [("Sales", 4.0), ("Turnover", 5.0)], 53: [("Sales", 6.0)]}
    rows = [observation(cik, f"{cik}-a", "2022-03-02", v, tag) for cik, first in told.items() for tag, v in first]
    rows += [observation(cik, f"{cik}-b", "2022-09-02", v, "Turnover") for cik, v in ((51, 9.0), (52, 5.0), (53, 6.5))]
    tags = spark.createDataFrame([("Sales", "Turnover"), ("Turnover", "Turnover")], "tag string, representative string")
    assert [(r["cik"], r["v_old"], r["v_new"]) for r in revisions.events(make(rows), tags).collect()] == [(53, 6.0, 6.5)]
    assert revisions.merged_conflicts(make(rows), tags).first()["n_conflicts"] == 1 and revisions.events(make(rows)).count() == 0


def test_events_of_random_series_against_a_model(make):
    r = random.Random(7)
    rows, model = [], {}
    for cik in range(30):
        seen = []
        for k in range(r.randint(1, 8)):
            v = r.choice([None, 1.0, 2.0, 3.0])
            rows.append(observation(cik, f"f-{k}", f"2025-{1 + k:02d}-10", v))
            if v is not None:
                seen.append(v)
        model[cik] = [(a, b) for a, b in zip(seen, seen[1:]) if a != b]
    r.shuffle(rows)
    got = {c: [(e["v_old"], e["v_new"]) for e in of(revisions.events(make(rows)), c)] for c in model}
    assert got == model


def test_empty_tables(make):
    nothing = make([])
    census, events = revisions.census(nothing, CONFIG), revisions.events(nothing)
    tables = {k: t.count() for k, t in stats.compute(nothing, census, events).items()}
    assert tables == {"rate_by_threshold": 16, "magnitude_quantiles": 48, "rel_delta_quantiles": 24, "census_composition": 20, "left_censoring_sources": 0, "lag_quantiles": 288, "lag_bins": 336, "rate_by_tag": 0, "rate_by_tag_highest": 0, "silent_vs_amendment": 8, "version_and_scale_share": 8, "accepted_after_1600_share": 1}


def test_nearest_rank(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 2, 3, 10, 20)], "g string, v double")
    got = {r["quantile"]: r["value"] for r in nearest_rank(df, "v", ["g"], [0.5, 0.9, 1.0]).collect()}
    assert got == {0.5: 3.0, 0.9: 20.0, 1.0: 20.0}


def test_spearman(spark):
    def rho(pairs):
        return spearman(spark.createDataFrame([("g", float(a), float(b)) for a, b in pairs], "g string, a double, b double"), ["g"], "a", "b").first()["rho"]

    r = random.Random(3)
    x = [r.random() for _ in range(50)]
    assert rho(zip(x, x)) == 1.0 and rho(zip(x, [-v for v in x])) == -1.0 and rho(zip(x, [v**3 for v in x])) == 1.0
    assert abs(rho(zip([10, 20, 20, 30], [1, 2, 3, 4])) - 0.9486832980505138) < 1e-12
    assert rho([(1, 2)]) is None and rho([(1, 2), (1, 3)]) is None


def test_dates(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2024, 2, 14), d(2024, 2, 15), d(2023, 12, 31))], "a date, b date, s date")
    row = df.select(month_end(F.col("a")).alias("a"), month_end(F.col("b")).alias("b"), qtrs_between(F.col("s"), F.col("b")).alias("q"), qtrs_between(F.lit(None).cast("date"), F.col("b")).alias("z")).first()
    assert tuple(row) == (d(2024, 1, 31), d(2024, 2, 29), 1, 0)


def test_distinct_values_are_told_as_numbers(make):
    """Zeros of either sign are one value, and so is what is no number."""
    values = {1: [0.0, -0.0], 2: [float("nan"), float("nan")], 3: [float("nan"), 1.0, float("nan")], 4: [5.0, 6.0, 5.0, 7.0], 5: [2.0]}
    rows = make([observation(cik, f"{cik}-{k}", f"2022-0{k + 1}-01", v) for cik, vs in values.items() for k, v in enumerate(vs)])
    got = {r["cik"]: (r["n_obs"], r["n_distinct_val"], r["n_revisions"], r["revised"]) for r in revisions.census(rows, CONFIG).collect()}
    assert got == {1: (2, 1, 0, False), 2: (2, 1, 0, False), 3: (3, 2, 1, True), 4: (4, 3, 2, True), 5: (1, 1, 0, False)}
