import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxgrain.functions.sampling import draw
from voxgrain.operators import labels as la
from voxgrain.operators import profiling as pr
from voxgrain.operators import ranking as rk


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds four fifths of the rows."""
    group = F.when(F.col("id") % 5 < 4, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string")))
    return spark.range(5000).withColumn("g", group).withColumn("v", F.pmod(F.hash("id"), F.lit(997)).cast("double"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def plain_rank(df, limit):
    w = Window.partitionBy("g").orderBy(F.desc("v"), "id")
    return rows(df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("g", "id", "rank"))


@pytest.mark.parametrize("limit", [3, 1500])
def test_keep_top_is_exact(skewed, limit):
    found = rk.keep_top(skewed, ["g"], [F.desc("v"), F.asc("id")], limit, "id")
    assert rows(found.select("g", "id", "rank")) == plain_rank(skewed, limit)


def test_keep_top_with_limit_per_group(skewed):
    limit = F.when(F.col("g") == "hot", 7).otherwise(2)
    for bound in (7, None, 5000):
        found = rk.keep_top(skewed, ["g"], [F.desc("v"), F.asc("id")], limit, "id", bound)
        sizes = {r["g"]: r["count"] for r in found.groupBy("g").count().collect()}
        assert sizes.pop("hot") == 7 and set(sizes.values()) == {2}


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_groups_are_cut_before_the_shuffle(skewed):
    assert plan_of(rk.keep_top(skewed, ["g"], [F.desc("v"), F.asc("id")], 3, "id")).count("WindowGroupLimit") == 2
    assert plan_of(rk.first_per_key(skewed, ["g"], [F.col("id")])).count("WindowGroupLimit") == 2


def test_number_within_equals_row_number(skewed):
    drawn = skewed.withColumn("d", draw("id"))
    w = Window.partitionBy("g").orderBy("d", "id")
    expected = rows(drawn.withColumn("n", F.row_number().over(w)).select("g", "id", "n"))
    found = rk.number_within(drawn, ["g"], "d", "id", "n", total="t")
    assert rows(found.select("g", "id", "n")) == expected
    assert found.where((F.col("g") == "hot") & (F.col("t") != 4000)).count() == 0


@pytest.mark.parametrize("probabilities", [(0.5,), (0.25, 0.5, 0.75), (0.0, 0.013, 1.0)])
def test_quantiles_equal_numpy(skewed, probabilities):
    pdf = skewed.toPandas()
    names = [rk.quantile_name(p) for p in probabilities]
    counts = rk.value_counts(skewed, "v")
    for found in (rk.quantiles_in_slots(counts, "v", probabilities), rk.exact_quantiles(skewed, "v", probabilities)):
        got = found.first()
        assert np.allclose([got[n] for n in names], np.quantile(pdf["v"], probabilities))
    grouped = rk.quantiles_in_slots(rk.value_counts(skewed, "v", ["g"]), "v", probabilities, ["g"]).collect()
    for row in grouped:
        assert np.allclose([row[n] for n in names], np.quantile(pdf[pdf.g == row["g"]]["v"], probabilities))


def test_folds_and_split_are_balanced(skewed):
    folds = la.stratified_folds(skewed, "g", "id", 5).groupBy("g", "fold").count().collect()
    by = {}
    for r in folds:
        by.setdefault(r["g"], []).append(r["count"])
    assert all(max(c) - min(c) <= 1 for c in by.values())
    split = la.stratified_split(skewed, "g", "id").where("is_validation").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in split}["hot"] == 800


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "v double")
    assert {r["bin"]: r["n"] for r in pr.histogram(df, "v", 10).collect()} == {0: 1, 5: 1, 9: 1}
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [(r["bin"], r["n"]) for r in pr.histogram(same, "v", 10).collect()] == [(0, 2)]


def test_day_extremes_take_the_earliest(spark):
    df = spark.sql("SELECT explode(array(timestamp'2024-01-02 01:00:00', timestamp'2024-01-01 02:00:00')) AS timestamp")
    row = pr.day_extremes(df).first()
    assert str(row["busiest_day"]) == str(row["quietest_day"]) == "2024-01-01"


def test_histogram_makes_its_values_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def value(n):
        seen.add(1)
        return n

    df = spark.range(20).select(F.udf(value, "long")("id").alias("v"))
    assert sum(r["n"] for r in pr.histogram(df, "v", 4).collect()) == 20
    assert seen.value == 20
