"""The two figures, from aggregates of the tables; drawn where matplotlib is installed."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import stats


def census_data(census: DataFrame, events: DataFrame, censoring: str = "all") -> dict:
    """What the census figure shows: rates by threshold, and the bins of log magnitude and of lag up to its 99.5th percentile."""
    tagged = stats.with_flags(events, census)
    rates = stats.rate_by_threshold(census, tagged).where(F.col("censoring") == censoring).orderBy("threshold").collect()
    sized = stats.by_group(census.where("revised and not from_zero and not ever_scale_change and magnitude > 0")).where(F.col("censoring") == censoring)
    magnitudes = sized.groupBy(F.floor(F.log10("magnitude") * 5).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()
    lags = stats.lag_histogram(tagged, censoring).orderBy("bin").collect()
    return {"rates": [(r["threshold"], r["rate"]) for r in rates], "magnitudes": [(r["bin"] / 5, r["n"]) for r in magnitudes], "lags": [(15 * r["bin"], r["n"]) for r in lags]}


def vintage_data(verdicts: DataFrame, by_date: DataFrame) -> dict:
    """What the vintage figure shows: the verdict of each program and its curve over days."""
    rows = by_date.orderBy("program", "asof").collect()
    curves: dict[str, list] = {}
    for r in rows:
        curves.setdefault(r["program"], []).append((r["asof"], r["lambda_cell"]))
    return {"verdicts": {r["program"]: (r["truncation_pass"], r["vintage_pass"], r["verdict"]) for r in verdicts.collect()}, "curves": curves}


def build_all(census: dict, vintage: dict, folder: Path) -> list[Path]:
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    folder.mkdir(parents=True, exist_ok=True)
    fig, axes = plt.subplots(1, 3, figsize=(15, 4))
    axes[0].bar([f"> {t:g}" for t, _ in census["rates"]], [r or 0 for _, r in census["rates"]])
    axes[1].bar([b for b, _ in census["magnitudes"]], [n for _, n in census["magnitudes"]], width=0.2)
    axes[2].bar([b for b, _ in census["lags"]], [n for _, n in census["lags"]], width=15)
    for ax, title in zip(axes, ("rate by threshold", "log10 magnitude", "days since first filed")):
        ax.set_title(title)
    fig.savefig(folder / "census.png", dpi=120)
    fig, axes = plt.subplots(1, 2, figsize=(12, 4))
    for name, (trunc, vint, word) in vintage["verdicts"].items():
        axes[0].text(0.25 + 0.5 * (not vint), 0.75 - 0.5 * (not trunc) - 0.06 * list(vintage["verdicts"]).index(name), f"{name}: {word}", ha="center")
    for name, curve in vintage["curves"].items():
        axes[1].plot([d for d, _ in curve], [v for _, v in curve], label=name)
    axes[1].legend()
    fig.savefig(folder / "vintage.png", dpi=120)
    plt.close("all")
    return [folder / "census.png", folder / "vintage.png"]
