import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import observation
from tideline.operators import facts


def value(df, cik):
    return [r["value"] for r in df.where(F.col("cik") == cik).collect()]


@pytest.mark.parametrize("day, known", [("2022-02-17", []), ("2022-02-18", [640.0]), ("2022-03-03", [640.0]), ("2022-03-04", [655.0]), ("2022-11-09", [655.0]), ("2022-11-10", [640.0])])
def test_a_day_shows_the_version_of_that_day(vintages, day, known):
    assert value(facts.as_of(vintages, dt.date.fromisoformat(day)), 71) == known


def test_later_days_know_more_and_the_last_knows_all(vintages):
    seen = 0
    for month in range(2, 13):
        day = dt.date(2022, month, 15)
        known = facts.as_of(vintages, day)
        assert known.where(F.col("filed") > F.lit(day)).count() == 0 and known.count() >= seen
        seen = known.count()
    last = facts.as_of(vintages, dt.date(2023, 6, 1))
    assert last.exceptAll(facts.latest(vintages)).count() == 0 == facts.latest(vintages).exceptAll(last).count()


def test_a_later_null_wins(vintages):
    assert value(facts.as_of(vintages, dt.date(2022, 6, 1)), 73) == [None] and value(facts.latest(vintages), 73) == [7.0]


def test_worlds_differ_where_a_value_changed_after_the_day(vintages):
    def ciks(day):
        return {r["cik"] for r in facts.diff_worlds(vintages, dt.date.fromisoformat(day)).collect()}

    assert ciks("2022-02-20") == {73}  # 71 ends as it began; 72 isn't known yet
    assert ciks("2022-03-15") == {71, 72, 73, 83}
    assert ciks("2022-08-19") == {71} and ciks("2022-11-10") == set()


def test_worlds_leave_out_facts_without_a_whole_key(make):
    rows = make([observation(None, "k-1", "2022-02-01", 3.0), observation(None, "k-2", "2022-04-01", 4.0)])
    assert facts.diff_worlds(rows, dt.date(2022, 3, 1)).count() == 0


def test_primary_key(vintages):
    assert facts.assert_primary_key(vintages) == 1
    with pytest.raises(facts.PrimaryKeyViolation):
        facts.assert_primary_key(vintages.union(vintages.limit(1)))


def test_ties_in_the_day_go_to_the_later_filing(make):
    rows = make([observation(4, "t-8", "2022-05-02", 18.0), observation(4, "t-9", "2022-05-02", 19.0)])
    assert value(facts.latest(rows), 4) == [19.0]


def test_freeze(vintages):
    frozen = facts.freeze_first(vintages)
    assert set(value(frozen, 71)) == {640.0} and value(frozen, 73) == [0.0] * 3 and value(frozen, 74) == [33.0]
