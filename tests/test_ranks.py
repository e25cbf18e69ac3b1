import random

from pyspark.sql import functions as F

from tideline.functions import ranks


def test_selection_equals_the_ranks_of_all_values(spark, monkeypatch):
    """Ties, negative, tiny, huge and few values, null groups and null values; in two parts a round and in many."""
    r, rows = random.Random(2), []
    for group, values in {
        "uniform": [r.random() for _ in range(500)],
        "heavy": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(300)],
        "ties": [float(r.randint(0, 3)) for _ in range(400)],
        "one": [7.5],
        "same": [0.25] * 50,
        "ends": [-1.7e308, 1.7e308, 0.0, -0.0, 5e-324],
        None: [r.gauss(0, 1) for _ in range(99)] + [None] * 5,
        "nulls": [None] * 4,
    }.items():
        rows += [(group, v) for v in values]
    df = spark.createDataFrame(rows, "g string, v double")
    quantiles = (0.0, 0.5, 0.75, 0.9, 0.99, 1.0)
    groups = df.where("g is not null")
    want = sorted(map(str, ranks.nearest_rank(groups.withColumn("v", F.col("v") + 0.0), "v", ("g",), quantiles).collect()))
    for parts in (1024, 7):
        monkeypatch.setattr(ranks, "PARTS", parts)
        got = ranks.selected(df, "v", ("g",), quantiles)
        assert sorted(map(str, got.where("g is not null").withColumn("value", F.col("value") + 0.0).collect())) == want
        assert got.where("g is null").count() == len(quantiles)
    assert ranks.selected(df.limit(0), "v", ("g",), quantiles).count() == 0
