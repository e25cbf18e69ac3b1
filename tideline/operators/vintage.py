"""The vintage experiment: does a program's output depend on revisions it could not know?

A program scores companies as of a day. It is run in two worlds, one that holds
what was filed by that day and one that holds everything; a difference is a
leak. All programs, worlds and days are one query: each fact is set against the
days it can matter for, reduced to its versions, and the programs choose among
these.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import spearman
from ..functions.scalar import ratio
from .facts import freeze_first, pick_latest

#: Tag and quarters of what the programs read.
ITEMS = {"assets": ("Assets", 0), "ni": ("NetIncomeLoss", 4), "eq": ("StockholdersEquity", 0)}
PROGRAMS = ("correct", "naive", "lookahead", "restated")
LOOKAHEAD_DAYS = 365
EPSILON = 1e-12


Day = dt.date | Column


def _as_column(day: Day) -> Column:
    return day if isinstance(day, Column) else F.lit(day)


#: What tells a run of a program: its world, where its periods are cut off, and its day.
RUN = ("world", "point", "asof")
Run = tuple[str, dt.date | None, dt.date]


class DataHandle:
    """Read access for a program: whole rows, a convenient latest view that hides when a value was filed, an as-of view, and a revised one of what was known by then."""

    #: The columns by which a program groups and joins companies.
    key: tuple[str, ...] = ("cik",)

    def __init__(self, facts: DataFrame, world: str) -> None:
        self._facts, self.world = facts, world

    def frame(self, tag: str | None = None, qtrs: int | None = None) -> DataFrame:
        out = self._facts
        if tag is not None:
            out = out.where(F.col("tag") == tag)
        return out if qtrs is None else out.where(F.col("qtrs") == qtrs)

    def latest(self, tag: str, qtrs: int, ddate_max: Day) -> DataFrame:
        """(cik, ddate, value): the newest period of each company, in its newest version."""
        return newest_period(self.frame(tag, qtrs).where(F.col("ddate") <= _as_column(ddate_max)), ("cik", "ddate", "value"))

    def as_of(self, tag: str, qtrs: int, day: Day) -> DataFrame:
        """(cik, ddate, value, filed, adsh): the same, of what was filed by the day."""
        known = self.frame(tag, qtrs).where((F.col("ddate") <= _as_column(day)) & (F.col("filed") <= _as_column(day)))
        return newest_period(known, ("cik", "ddate", "value", "filed", "adsh"))

    def revised(self, tag: str, qtrs: int, day: Day) -> DataFrame:
        """(cik, ddate, value): the newest period of which something was filed by the day, in its newest version."""
        told = (F.col("ddate") <= _as_column(day)) & (F.col("filed") <= _as_column(day))
        periods = self.frame(tag, qtrs).groupBy("cik", "ddate").agg(F.max_by("value", F.struct("filed", "adsh", "uom")).alias("value"), F.bool_or(told).alias("told"))
        return periods.where("told").groupBy("cik").agg(F.max_by(F.struct("ddate", "value"), "ddate").alias("r")).select("cik", "r.*")


class RunsHandle(DataHandle):
    """The same access for all worlds, points and days at once: rows come once for each run that sees them, with its ``RUN`` columns.

    ``day`` is a column here, that of the run or one made of it; a company of a
    run is told by ``key``. Latest, as-of and revised views keep the last
    version of each day of filing and gather a period's days before these meet
    the runs, so what is multiplied is a row for each company and period.
    ``frame`` gives every row once for each run.
    """

    key = (*RUN, "cik")

    def __init__(self, facts: DataFrame, runs: Sequence[Run]) -> None:
        super().__init__(facts, "all")
        self._runs = F.array(*[F.struct(F.lit(w).alias("world"), F.lit(p).cast("date").alias("point"), F.lit(d).cast("date").alias("asof")) for w, p, d in runs])

    def _met(self, rows: DataFrame) -> DataFrame:
        """Rows beside each run in which their period exists."""
        return rows.withColumn("run", F.explode(self._runs)).select("*", *[F.col(f"run.{c}").alias(c) for c in RUN]).drop("run").where("point is null or ddate <= point")

    def frame(self, tag: str | None = None, qtrs: int | None = None) -> DataFrame:
        return self._met(super().frame(tag, qtrs)).where("world = 'rev' or filed <= asof")

    def _newest(self, tag: str, qtrs: int, ddate_max: Column, filed_max: Column | None, revised: bool = False) -> DataFrame:
        """The newest period up to ``ddate_max`` with a version filed by ``filed_max``: in the last such version or, ``revised``, in the last that the run sees."""
        days = DataHandle.frame(self, tag, qtrs).groupBy("cik", "ddate", "filed").agg(F.max(F.struct("adsh", "uom", "value")).alias("v"))
        periods = days.select("cik", "ddate", F.struct("filed", "v.*").alias("version")).groupBy("cik", "ddate").agg(F.sort_array(F.collect_list("version")).alias("versions"))
        seen = self._met(periods).where(F.col("ddate") <= ddate_max).withColumn("filed_max", filed_max if filed_max is not None else F.lit(None).cast("date"))
        visible = F.filter("versions", lambda v: (F.col("world") == "rev") | (v["filed"] <= F.col("asof")))
        known = F.filter(visible, lambda v: F.col("filed_max").isNull() | (v["filed"] <= F.col("filed_max")))
        version = F.when(F.size(known) > 0, F.try_element_at(visible if revised else known, F.lit(-1)))
        told = seen.withColumn("v", version).where("v is not null")
        return told.groupBy(*self.key).agg(F.max_by(F.struct("ddate", "v"), "ddate").alias("r")).select(*self.key, "r.ddate", "r.v.*")

    def latest(self, tag: str, qtrs: int, ddate_max: Column) -> DataFrame:
        return self._newest(tag, qtrs, ddate_max, None).select(*self.key, "ddate", "value")

    def as_of(self, tag: str, qtrs: int, day: Column) -> DataFrame:
        return self._newest(tag, qtrs, day, day).select(*self.key, "ddate", "value", "filed", "adsh")

    def revised(self, tag: str, qtrs: int, day: Column) -> DataFrame:
        return self._newest(tag, qtrs, day, day, revised=True).select(*self.key, "ddate", "value")


def world_pit(facts: DataFrame, day: dt.date) -> DataHandle:
    return DataHandle(facts.where(F.col("filed") <= F.lit(day)), "pit")


def world_rev(facts: DataFrame) -> DataHandle:
    return DataHandle(facts, "rev")


def newest_period(facts: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A company's row, or some columns of it, with the greatest (ddate, filed, adsh, uom)."""
    return pick_latest(facts, ("cik",), ("ddate", "filed", "adsh", "uom"), columns)


def universe(assets: DataFrame, n: int) -> DataFrame:
    """(cik, value): the n companies with most assets, ties to the smaller cik; of each run, where rows have one."""
    run = [c for c in RUN if c in assets.columns]
    if not run:
        return assets.where("value > 0").orderBy(F.desc("value"), "cik").limit(n).select("cik", "value")
    place = F.row_number().over(Window.partitionBy(*run).orderBy(F.desc("value"), "cik"))
    return assets.where("value > 0").withColumn("place", place).where(F.col("place") <= n).select(*run, "cik", "value")


Program = Callable[[DataHandle, Day, int], DataFrame]


def all_days(read: Program) -> Program:
    """Marks a program that runs for all worlds and days at once: it groups and joins by ``db.key``, treats ``day`` as a column, and limits nothing but by ``universe``."""
    read.all_days = True
    return read


def program(read: Callable[[DataHandle, str, int, dt.date], DataFrame]) -> Program:
    """A program that scores return on equity, given how it reads a tag: (handle, day, n) -> (cik, value)."""

    def run(db: DataHandle, day: dt.date, n: int) -> DataFrame:
        item = {name: read(db, tag, qtrs, day) for name, (tag, qtrs) in ITEMS.items()}
        key, by = list(db.key), [c for c in db.key if c != "cik"]
        both = universe(item["assets"], n).select(*key)
        for name in ("ni", "eq"):
            # Points may be null: keys meet null-safely.
            other = item[name].select(*[F.col(c).alias(f"of_{c}") for c in key], F.col("value").alias(name))
            both = both.join(other, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in key])).drop(*[f"of_{c}" for c in key])
        rows = with_roe(both)
        return (standardised(rows, by) if by else standardised(rows.withColumn("all", F.lit(0)), ("all",))).select(*key, "value")

    return all_days(run)


def later(day: Day, days: int) -> Day:
    return F.date_add(day, days) if isinstance(day, Column) else day + dt.timedelta(days=days)


#: The programs one day at a time; ``panel`` runs them for all days at once.
PROGRAM_FUNCTIONS: dict[str, Program] = {
    "correct": program(lambda db, tag, qtrs, day: db.as_of(tag, qtrs, day)),
    "naive": program(lambda db, tag, qtrs, day: db.latest(tag, qtrs, day)),
    "lookahead": program(lambda db, tag, qtrs, day: db.latest(tag, qtrs, later(day, LOOKAHEAD_DAYS))),
    "restated": program(lambda db, tag, qtrs, day: db.revised(tag, qtrs, day)),
}


def with_roe(items: DataFrame) -> DataFrame:
    """Rows with a finite return on equity."""
    roe = F.try_divide("ni", "eq")
    return items.withColumn("roe", roe).where(F.col("roe").isNotNull() & ~F.isnan("roe") & (F.abs("roe") < float("inf")))


def standardised(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., cik, roe, value): standard scores within each group, with the sample deviation.

    Sums run in cik order over the group's list, which the universe bounds, so
    equal inputs give equal scores to the last bit. Groups of under two rows or
    without spread give none.
    """
    groups = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("cik", "roe"))).alias("all_rows"))
    n = F.size("all_rows").cast("double")
    total = F.aggregate("all_rows", F.lit(0.0), lambda s, x: s + x["roe"])
    mean = groups.withColumn("mean", total / n)
    squares = F.aggregate("all_rows", F.lit(0.0), lambda s, x: s + (x["roe"] - F.col("mean")) * (x["roe"] - F.col("mean")))
    spread = mean.withColumn("sd", F.sqrt(F.try_divide(squares, n - 1))).where((n >= 2) & (F.col("sd") > 0) & (F.col("sd") < float("inf")))
    flat = spread.select(*by, "mean", "sd", F.explode("all_rows").alias("r"))
    return flat.select(*by, "r.cik", "r.roe", ((F.col("r.roe") - F.col("mean")) / F.col("sd")).alias("value"))


def days_array(days: Sequence[dt.date]) -> Column:
    return F.array(*[F.lit(d).cast("date") for d in days])


def choices(facts: DataFrame, days: Sequence[dt.date], points: Sequence[dt.date] = ()) -> DataFrame:
    """(program, world, point, asof, cik, item, value): what each program reads in each world, for each day.

    Facts are first gathered to one row a period with the list of its versions,
    which the filings of one company bound; only then each meets the days it
    can matter for, with its version known by the day and its latest one, and
    the programs pick among the periods. The list of days is short and literal:
    facts meet it without a join. With truncation points each day comes once
    more for every point from it on, where only periods up to the point exist;
    point is null where nothing is cut off.
    """
    item = F.coalesce(*[F.when((F.col("tag") == tag) & (F.col("qtrs") == qtrs), name) for name, (tag, qtrs) in ITEMS.items()])
    rows = facts.withColumn("item", item).where("item is not null")
    periods = rows.groupBy("item", "cik", "ddate").agg(F.sort_array(F.collect_list(F.struct("filed", "adsh", "uom", "value"))).alias("versions"))
    wanted = [(None, d) for d in days] + [(p, d) for p in points for d in days if d <= p]
    runs_ = F.array(*[F.struct(F.lit(p).cast("date").alias("point"), F.lit(d).cast("date").alias("asof")) for p, d in wanted])
    near = F.filter(runs_, lambda r: (F.col("ddate") <= F.date_add(r["asof"], LOOKAHEAD_DAYS)) & (r["point"].isNull() | (F.col("ddate") <= r["point"])))

    def told(r: Column) -> Column:
        last = F.try_element_at(F.filter("versions", lambda v: v["filed"] <= r["asof"]), F.lit(-1))
        return F.struct(r["point"].alias("point"), r["asof"].alias("asof"), F.when(last.isNotNull(), F.struct(last["value"].alias("value"))).alias("pit"))

    newest = F.struct(F.element_at("versions", -1)["value"].alias("value"))
    versions = periods.select("item", "cik", "ddate", newest.alias("rev"), F.explode(F.transform(near, told)).alias("r")).select("*", "r.*").drop("r")
    past, known = F.col("ddate") <= F.col("asof"), F.col("pit").isNotNull()

    def at(value: str, condition: Column | None) -> Column:
        if condition is None:
            return F.max_by(F.col(value), F.col("ddate"))
        return F.max_by(F.when(condition, F.col(value)), F.when(condition, F.col("ddate")))

    picked = versions.groupBy("point", "asof", "item", "cik").agg(
        at("pit", past & known).alias("known"), at("rev", past).alias("newest"), at("pit", known).alias("ahead_known"), at("rev", None).alias("ahead"), at("rev", past & known).alias("restated")
    )
    table = {("correct", "pit"): "known", ("correct", "rev"): "known", ("naive", "pit"): "known", ("naive", "rev"): "newest", ("lookahead", "pit"): "ahead_known", ("lookahead", "rev"): "ahead", ("restated", "pit"): "known", ("restated", "rev"): "restated"}
    cells = F.array(*[F.struct(F.lit(p).alias("program"), F.lit(w).alias("world"), F.col(c).alias("v")) for (p, w), c in table.items()])
    return picked.select("point", "asof", "cik", "item", F.explode(cells).alias("c")).where("c.v is not null").select("c.program", "c.world", "point", "asof", "cik", "item", F.col("c.v.value").alias("value"))


def scored(chosen: DataFrame, n: int, by: Sequence[str] = ("program", "world", "asof")) -> DataFrame:
    """(by..., cik, roe, value) from what the programs read."""
    wide = chosen.groupBy(*by, "cik").agg(*[F.max(F.when(F.col("item") == name, F.col("value"))).alias(name) for name in ITEMS])
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("assets"), "cik"))
    top = wide.where("assets > 0").withColumn("place", place).where(F.col("place") <= n)
    return standardised(with_roe(top), by)


def runs(facts: DataFrame, days: Sequence[dt.date], points: Sequence[dt.date], n: int) -> DataFrame:
    """(program, world, point, asof, cik, roe, value): all that the panel and the truncation test need, in one query."""
    chosen = choices(facts, days, points).where("point is null or world = 'rev'")
    return scored(chosen, n, ("program", "world", "point", "asof")).select("program", "world", "point", "asof", "cik", "roe", "value")


def panel_of_runs(runs_: DataFrame) -> DataFrame:
    return runs_.where("point is null").select("program", "world", "asof", "cik", "value")


def panel(facts: DataFrame, days: Sequence[dt.date], n: int) -> DataFrame:
    """(program, world, asof, cik, value) of all programs, both worlds and all days."""
    return panel_of_runs(runs(facts, days, (), n))


def runs_of(programs: Mapping[str, Program], facts: DataFrame, days: Sequence[dt.date], points: Sequence[dt.date], n: int) -> DataFrame:
    """(program, world, point, asof, cik, value) of programs of one's own: functions of (handle, day, n) that give (cik, value).

    Both worlds on every day, and the full world cut off at each point not
    before the day. A program marked by ``all_days`` is one plan over all of
    these. Any other is a plan for each, put together with the rest.
    """
    wanted: list[Run] = [(w, None, d) for d in days for w in ("pit", "rev")] + [("rev", p, d) for p in points for d in days if d <= p]
    together, parts = RunsHandle(facts, wanted), []
    for name, read in programs.items():
        if getattr(read, "all_days", False):
            parts.append(read(together, F.col("asof"), n).select(F.lit(name).alias("program"), *RUN, "cik", F.col("value").cast("double").alias("value")))
            continue
        for world, point, day in wanted:
            seen = facts if point is None else facts.where(F.col("ddate") <= F.lit(point))
            parts.append(_run(name, read, world_pit(seen, day) if world == "pit" else world_rev(seen), point, day, n))
    return reduce(DataFrame.unionAll, parts)


def _run(name: str, read: Program, handle: DataHandle, point: dt.date | None, day: dt.date, n: int) -> DataFrame:
    keys = [F.lit(name).alias("program"), F.lit(handle.world).alias("world"), F.lit(point).cast("date").alias("point"), F.lit(day).cast("date").alias("asof")]
    return read(handle, day, n).select(*keys, "cik", F.col("value").cast("double").alias("value"))


def panel_of(programs: Mapping[str, Program], facts: DataFrame, days: Sequence[dt.date], n: int) -> DataFrame:
    """The panel of programs of one's own, run in both worlds on every day."""
    return runs_of(programs, facts, days, (), n).drop("point")


def cells(panel_: DataFrame, tolerance: float) -> DataFrame:
    """(program, asof, cik, y_pit, y_rev, differs): both worlds side by side; a score in one world alone differs."""
    sides = panel_.groupBy("program", "asof", "cik").agg(*[F.max(F.when(F.col("world") == w, F.col("value"))).alias(f"y_{w}") for w in ("pit", "rev")])
    apart = F.abs(F.col("y_pit") - F.col("y_rev")) / (F.abs("y_pit") + EPSILON) > tolerance
    return sides.withColumn("differs", F.coalesce(apart, F.lit(True)))


def rank_terms(cells_: DataFrame, by: Sequence[str] = ("program", "asof")) -> DataFrame:
    """(by..., term): 1 - rank correlation of the two worlds, where it is defined."""
    return spearman(cells_, by, "y_pit", "y_rev").where("rho is not null").select(*by, (1 - F.col("rho")).alias("term"))


def lambdas(panel_: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(program, lambda_cell, lambda_rank, n_cells, n_diff)."""
    both = cells(panel_, tolerance)
    counts = both.groupBy("program").agg(F.count("*").alias("n_cells"), F.count_if("differs").alias("n_diff"))
    ranks = rank_terms(both).groupBy("program").agg(F.avg("term").alias("lambda_rank"))
    return counts.join(ranks, "program", "left").select("program", ratio(F.col("n_diff"), F.col("n_cells")).alias("lambda_cell"), F.coalesce("lambda_rank", F.lit(0.0)).alias("lambda_rank"), "n_cells", "n_diff")


def lambda_by_date(panel_: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(program, asof, lambda_cell, lambda_rank): the curve over days; the rank part is null where undefined."""
    both = cells(panel_, tolerance)
    counts = both.groupBy("program", "asof").agg(F.count("*").alias("n_cells"), F.count_if("differs").alias("n_diff"))
    return counts.join(rank_terms(both), ["program", "asof"], "left").select("program", "asof", ratio(F.col("n_diff"), F.col("n_cells")).alias("lambda_cell"), F.col("term").alias("lambda_rank"))


def truncation_of_runs(runs_: DataFrame, days: Sequence[dt.date], points: Sequence[dt.date], same: str = "roe", names: Sequence[str] = PROGRAMS) -> DataFrame:
    """(program, n_failures) from runs with and without truncation, which are compared in column ``same``."""
    scores = runs_.where("world = 'rev'")
    after = F.explode(F.filter(days_array(points), lambda p: F.col("asof") <= p))
    sides = scores.where("point is null").select("program", "asof", "cik", F.col(same).alias("full"), F.lit(None).cast("double").alias("cut"), after.alias("point"), F.lit(0).alias("cuts"))
    sides = sides.union(scores.where("point is not null").select("program", "asof", "cik", F.lit(None).cast("double"), F.col(same), "point", F.lit(1)))
    # A company in one of the two alone differs; a null score is a score.
    met = sides.groupBy("program", "asof", "point", "cik").agg(F.max("full").alias("full"), F.max("cut").alias("cut"), (F.min("cuts") == F.max("cuts")).alias("alone"))
    bad = met.where(F.col("alone") | ~F.col("full").eqNullSafe(F.col("cut"))).select("program", "asof", "point").distinct()
    listed = runs_.sparkSession.createDataFrame([(p,) for p in names], "program string")
    return F.broadcast(listed).join(bad.groupBy("program").agg(F.count("*").alias("n")), "program", "left").select("program", F.coalesce("n", F.lit(0)).cast("long").alias("n_failures"))


def truncation(facts: DataFrame, days: Sequence[dt.date], points: Sequence[dt.date], n: int) -> DataFrame:
    """(program, n_failures): point and day pairs, the day not after the point, whose scores change when later periods are cut off.

    The point is one more dimension of the same query. Scores are equal exactly
    when the companies and their returns are.
    """
    some = [d for d in days if d <= max(points)]
    return truncation_of_runs(runs(facts, some, points, n), some, points)


def truncation_of(programs: Mapping[str, Program], facts: DataFrame, days: Sequence[dt.date], points: Sequence[dt.date], n: int) -> DataFrame:
    """(program, n_failures) of programs of one's own: their outputs have to be equal exactly where later periods are cut off."""
    some = [d for d in days if d <= max(points)]
    return truncation_of_runs(runs_of(programs, facts, some, points, n), some, points, "value", list(programs))


def verdict(passes_truncation: Column, passes_vintage: Column) -> Column:
    return F.when(passes_truncation & passes_vintage, "clean").when(passes_truncation, "silent_leak").when(passes_vintage, "obvious_bug").otherwise("double_failure")


def verdicts(lambdas_: DataFrame, truncations: DataFrame) -> DataFrame:
    """(program, truncation_pass, lambda_cell, lambda_rank, n_cells, n_diff, vintage_pass, verdict); no cells count as a pass."""
    ok = F.coalesce(F.col("lambda_cell"), F.lit(0.0)) == 0
    out = truncations.join(lambdas_, "program", "left").fillna(0, ["n_cells", "n_diff"])
    out = out.select("program", (F.col("n_failures") == 0).alias("truncation_pass"), "lambda_cell", "lambda_rank", "n_cells", "n_diff", ok.alias("vintage_pass"))
    return out.withColumn("verdict", verdict(F.col("truncation_pass"), F.col("vintage_pass")))


def control(facts: DataFrame, days: Sequence[dt.date], n: int, tolerance: float = 1e-6, offset_days: int = 60) -> DataFrame:
    """The lambdas with and without revisions, at quarter ends and some days later."""
    frozen = freeze_first(facts)
    out = None
    for offset in (0, offset_days):
        shifted = [d + dt.timedelta(days=offset) for d in days]
        for name, rows in (("original", facts), ("no-revision", frozen)):
            part = lambdas(panel(rows, shifted, n), tolerance).select(F.lit(offset).alias("offset_days"), F.lit(name).alias("data"), "*")
            out = part if out is None else out.unionByName(part)
    return out
