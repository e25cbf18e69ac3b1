import datetime as dt

from pyspark.sql import functions as F

from tests.conftest import COMPANIES, DATA
from tideline.operators import renames, vintage

DAY = dt.date(2022, 3, 31)


def test_the_latest_view_hides_when_a_value_was_filed(vintages):
    db = vintage.world_rev(vintages)
    assert db.latest("NetIncomeLoss", 4, DAY).columns == ["cik", "ddate", "value"]
    assert "filed" in db.as_of("NetIncomeLoss", 4, DAY).columns
    assert {r["cik"]: r["value"] for r in db.latest("NetIncomeLoss", 4, DAY).collect()}[83] == -47.0
    assert {r["cik"]: r["value"] for r in db.as_of("NetIncomeLoss", 4, DAY).collect()} == {cik: v[2] for cik, v in COMPANIES.items()}


def test_programs_one_day_at_a_time_agree_with_the_panel(vintages):
    panel = vintage.panel(vintages, [DAY], 4)
    for name, run in vintage.PROGRAM_FUNCTIONS.items():
        for world, db in (("pit", vintage.world_pit(vintages, DAY)), ("rev", vintage.world_rev(vintages))):
            one = {r["cik"]: r["value"] for r in run(db, DAY, 4).collect()}
            rows = panel.where((F.col("program") == name) & (F.col("world") == world)).collect()
            assert {r["cik"]: r["value"] for r in rows} == one and set(one) == {81, 83, 85, 87}


def test_lambda_tells_programs_apart(vintages):
    got = {r["program"]: r for r in vintage.verdicts(vintage.lambdas(vintage.panel(vintages, [DAY], 5)), vintage.truncation(vintages, [DAY], [DAY], 5)).collect()}
    assert (got["correct"]["n_cells"], got["correct"]["n_diff"], got["correct"]["lambda_rank"], got["correct"]["verdict"]) == (5, 0, 0.0, "clean")
    assert got["naive"]["n_diff"] == 5 and got["naive"]["lambda_rank"] > 0 and got["naive"]["verdict"] == "silent_leak"


def test_looking_ahead_fails_truncation(make):
    from tests.conftest import observation as o

    rows = []
    for cik, scale in ((61, 1.0), (62, 2.5), (63, 4.0)):
        for ddate, filed, growth in (("2021-12-31", "2022-02-10", 1.0), ("2022-06-30", "2022-08-10", 1.0 + scale)):
            rows += [o(cik, f"{cik}-{ddate}", filed, v, t, ddate=ddate, qtrs=q) for t, v, q in (("Assets", 700 * scale, 0), ("NetIncomeLoss", scale * growth, 4), ("StockholdersEquity", 90.0, 0))]
    got = {r["program"]: r["n_failures"] for r in vintage.truncation(make(rows), [DAY], [DAY], 10).collect()}
    assert got == {"correct": 0, "naive": 0, "lookahead": 1, "restated": 0}


def test_classes():
    assert renames.classes([]) == {}
    assert renames.classes([("Pear", "Plum"), ("Plum", "Quince")]) == dict.fromkeys(("Pear", "Plum", "Quince"), "Quince")
    two = renames.classes([("Elm", "Oak"), ("Birch", "Fir"), ("Ash", "Oak"), ("Fir", "Alder")])
    assert two == dict.fromkeys(("Elm", "Oak", "Ash"), "Oak") | dict.fromkeys(("Birch", "Fir", "Alder"), "Fir")


def test_a_planted_rename_is_found(make):
    from tests.conftest import observation as o

    rules = renames.Rules(min_peak=5, recent=(2024, 2026), early=2013, min_shared=5, min_support=5)
    rows = []
    for cik in range(8):
        rows.append(o(cik, f"{cik}-1", "2012-04-12", 310.0 + 3 * cik, "FreightCost", ddate="2011-12-31"))
        rows.append(o(cik, f"{cik}-2", "2025-04-12", 310.0 + 3 * cik, "ShippingCost", ddate="2011-12-31"))
        rows.append(o(cik, f"{cik}-2", "2025-04-12", 5.0, "Postage", ddate="2010-12-31"))
    (found,) = renames.detect(make(rows), rules).collect()
    assert (found["old_tag"], found["new_tag"], found["accepted"], found["exact_agreement"], found["cooccurrence"]) == ("FreightCost", "ShippingCost", True, 1.0, 0.0)


def test_programs_of_all_days_are_one_plan_with_one_scan(spark):
    """The plan doesn't grow with the days, the facts are read once, and programs of one day at a time give the same."""
    from tideline.plans import catalogue
    from tideline.sources import bridge

    facts, days = bridge.observations(spark, DATA), catalogue.DAYS[5::12]

    def plan(days_):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            return vintage.panel_of(catalogue.USER_PROGRAMS, facts, days_, 50)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")

    few, many = plan(days[:2]), plan(catalogue.DAYS)
    assert few.count("FileScan") == many.count("FileScan") == 1 and len(few.splitlines()) == len(many.splitlines())
    single = {name: (lambda read: lambda db, day, n: read(db, day, n))(read) for name, read in {**catalogue.USER_PROGRAMS, **vintage.PROGRAM_FUNCTIONS}.items()}
    points, rows = catalogue.POINTS[1:2], {}
    for name, programs in (("one day", single), ("all days", {k: vintage.all_days(f) if k in catalogue.USER_PROGRAMS else vintage.PROGRAM_FUNCTIONS[k] for k, f in single.items()})):
        runs = vintage.runs_of(programs, facts, days, points, 50).collect()
        rows[name] = sorted((r["program"], r["world"], str(r["point"]), r["asof"], r["cik"], round(r["value"], 9)) for r in runs)
    assert rows["one day"] == rows["all days"] and len({r[0] for r in rows["all days"]}) == 7 and len({r[2] for r in rows["all days"]}) == 2


def test_versions_are_gathered_before_they_meet_the_runs(spark, make):
    """What is copied for each run is a row for each company and period, not one for each filing; this holds for every built-in program."""
    from tests.conftest import observation as o

    items = (("Assets", 0, 900.0), ("StockholdersEquity", 0, 300.0), ("NetIncomeLoss", 4, 20.0))
    filed = ("2022-02-10", "2022-05-10", "2022-11-10")
    rows = [o(cik, f"{cik}-{k:03d}", filed[k % 3], v * cik + k * k, tag, ddate=ddate, qtrs=q) for cik in (61, 62, 63, 64) for tag, q, v in items for ddate in ("2021-09-30", "2021-12-31") for k in range(60)]
    facts, days = make(rows), [DAY, dt.date(2022, 9, 30)]

    def made(plan):
        own = [plan.metrics().apply("numOutputRows").value()] if plan.nodeName() == "Generate" else []
        return own + [n for k in range(plan.children().size()) for n in made(plan.children().apply(k))]

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        panel = vintage.panel_of(vintage.PROGRAM_FUNCTIONS, facts, days, 10)
        got = {(r["program"], r["world"], r["asof"], r["cik"]): r["value"] for r in panel.collect()}
        assert 0 < max(made(panel._jdf.queryExecution().executedPlan())) <= 4 * 2 * 2 * len(days)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {(r["program"], r["world"], r["asof"], r["cik"]): r["value"] for r in vintage.panel(facts, days, 10).collect()} and len(got) == 4 * 2 * 2 * 4
