import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

from tideline.schema import OBSERVATIONS  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def day(text):
    return dt.date.fromisoformat(text)


def observation(cik, adsh, filed, value, tag="OperatingIncomeLoss", ddate="2021-12-31", qtrs=4, uom="EUR", form="10-K", period=None, version="gaap/2021", accepted=None):
    filed = day(filed)
    return (cik, adsh, form, filed, accepted or dt.datetime(filed.year, filed.month, filed.day, 9, 15), day(period or ddate), filed.year, "FY", tag, version, day(ddate), qtrs, uom, value, filed.year)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: spark.createDataFrame(rows, OBSERVATIONS)


#: Five companies of the vintage experiment: assets, equity, income.
COMPANIES = {81: (5200.0, 1300.0, 65.0), 83: (4700.0, 940.0, 141.0), 85: (4100.0, 2050.0, 41.0), 87: (3900.0, 780.0, 195.0), 89: (3100.0, 620.0, -62.0)}


@pytest.fixture(scope="session")
def vintages(make):
    """A series that is corrected and then set back, a unit slip, a zero with a gap behind it, a fact told once, and five companies one of which restates."""
    o = observation
    series = {
        71: ("OperatingIncomeLoss", 4, [("2022-02-18", 640.0, "10-K"), ("2022-03-04", 655.0, "10-K/A"), ("2022-08-12", 655.0, "10-Q"), ("2022-11-10", 640.0, "10-Q")]),
        72: ("InventoryNet", 0, [("2022-02-25", 12_000.0, "10-K"), ("2022-05-13", 12.0, "10-Q")]),
        73: ("Goodwill", 0, [("2022-02-11", 0.0, "10-K"), ("2022-05-20", None, "10-Q"), ("2022-08-19", 7.0, "10-Q")]),
        74: ("AccountsPayable", 0, [("2022-04-29", 33.0, "10-Q")]),
    }
    rows = [o(cik, f"{cik:04d}-22-{k}", filed, value, tag, qtrs=qtrs, form=form) for cik, (tag, qtrs, told) in series.items() for k, (filed, value, form) in enumerate(told)]
    for cik, values in COMPANIES.items():
        rows += [o(cik, f"{cik:04d}-22-0", "2022-03-11", v, tag, qtrs=q) for (tag, q), v in zip((("Assets", 0), ("StockholdersEquity", 0), ("NetIncomeLoss", 4)), values)]
    rows.append(o(83, "0083-22-1", "2022-08-05", -47.0, "NetIncomeLoss", form="10-Q"))
    return make(rows)
