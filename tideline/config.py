"""Quarters, the dates derived from a window of them, and the settings of a run."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from pathlib import Path

from .schema import BUCKETS, RIGHT_TRUNCATION_DAYS

MOST_AS_OF_DATES = 24
TRUNCATION_POINTS = 5


def quarter_number(quarter: str) -> int:
    """Quarters since year 0: '2023q3' -> 4 * 2023 + 2."""
    m = re.fullmatch(r"\s*(\d{4})[qQ]([1-4])\s*", quarter)
    if not m:
        raise ValueError(f"a quarter looks like 2023q3, not {quarter!r}")
    return 4 * int(m[1]) + int(m[2]) - 1


def quarter_name(number: int) -> str:
    return f"{number // 4}q{number % 4 + 1}"


def quarter_start(number: int) -> dt.date:
    return dt.date(number // 4, 3 * (number % 4) + 1, 1)


def quarter_end(number: int) -> dt.date:
    return quarter_start(number + 1) - dt.timedelta(days=1)


def quarters_between(first: str, last: str) -> tuple[str, ...]:
    a, b = quarter_number(first), quarter_number(last)
    if a > b:
        raise ValueError(f"{first} is after {last}")
    return tuple(quarter_name(n) for n in range(a, b + 1))


def thinned(items: tuple, most: int) -> tuple:
    """At most ``most`` items, evenly spread, the first and last among them."""
    if len(items) <= most:
        return tuple(items)
    return tuple(items[round(i * (len(items) - 1) / (most - 1))] for i in range(most))


@dataclass(frozen=True)
class Config:
    """A run: its quarters, where its data lies, and its settings."""

    quarters: tuple[str, ...] = field(default_factory=lambda: quarters_between("2009q2", "2026q2"))
    #: Where tables lie: a folder, or the URI of a store that Spark reads.
    root: str | Path = "."
    #: Where the driver keeps archives, reports and figures: the root itself, if that is a folder.
    local: Path | None = None
    user_agent: str = "tideline research contact@example.org"
    rate_limit_sleep: float = 0.15
    max_retries: int = 4
    universe_size: int = 200
    lambda_tol: float = 1e-6
    key_partitions: int = BUCKETS
    right_truncation_days: int = RIGHT_TRUNCATION_DAYS
    #: The days of the experiment and the points of its truncation test; derived from the quarters where they are None.
    days: tuple[dt.date, ...] | None = None
    points: tuple[dt.date, ...] | None = None

    @classmethod
    def of(cls, quarters: str | tuple[str, ...], root: str | Path = ".", **settings) -> Config:
        names = quarters.split(",") if isinstance(quarters, str) else quarters
        return cls(quarters=tuple(quarter_name(quarter_number(q)) for q in names if q.strip()), root=root, **settings)

    @property
    def numbers(self) -> tuple[int, ...]:
        return tuple(quarter_number(q) for q in self.quarters)

    @property
    def window_start(self) -> dt.date:
        return quarter_start(self.numbers[0])

    @property
    def window_end(self) -> dt.date:
        return quarter_end(self.numbers[-1])

    @property
    def left_cutoff(self) -> dt.date:
        """The day the second quarter begins, or the last day of a window of one: facts first seen before it may be older than the window."""
        return min([*map(quarter_start, self.numbers[1:2]), self.window_end])

    @property
    def as_of_dates(self) -> tuple[dt.date, ...]:
        """Ends of quarters, two of history kept before the first and one of revisions after the last, thinned; of short windows all but the last."""
        if self.days is not None:
            return self.days
        history = 2 if len(self.numbers) > 3 else 0
        middle = self.numbers[history : max(len(self.numbers) - 1, 1)]
        return thinned(tuple(map(quarter_end, middle)), MOST_AS_OF_DATES)

    @property
    def truncation_points(self) -> tuple[dt.date, ...]:
        return thinned(self.as_of_dates, TRUNCATION_POINTS) if self.points is None else self.points

    def table(self, *parts: str) -> str:
        """The path or URI of a table below the root."""
        return "/".join([str(self.root).rstrip("/"), "data", *parts])

    @property
    def folder(self) -> Path:
        if self.local is not None:
            return Path(self.local)
        root = str(self.root)
        return Path(root.removeprefix("file://") if root.startswith("file:///") else "." if "://" in root else root)

    @property
    def observations(self) -> str:
        return self.table("parquet", "observations")

    @property
    def raw_dir(self) -> Path:
        return self.folder / "data" / "raw"

    @property
    def out_dir(self) -> Path:
        return self.folder / "data" / "out"

    @property
    def figures_dir(self) -> Path:
        return self.folder / "figures"
