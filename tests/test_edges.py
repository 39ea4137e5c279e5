"""Empty, NaN, single and reordered input of the shared helpers."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from genesieve.functions import text
from genesieve.operators import evaluation, significance, stats
from genesieve.operators.ordered import hashed_row_number, split_ranges, value_rank
from genesieve.sources import files, tables

SCORES = ["a"]


def scores(spark, values):
    return spark.createDataFrame([(v,) for v in values], "a double")


@pytest.mark.parametrize("values", [[], [None], [float("nan")], [0.5], [0.5, float("nan"), None, 0.7, 0.7]])
def test_null_distribution_of_odd_input(spark, values):
    null = significance.null_distribution(significance.unpivot_scores(scores(spark, values), SCORES)).collect()
    real = [v for v in values if v is not None and not math.isnan(v)]
    assert {r.score: r.p for r in null} == {v: sum(x >= v for x in real) / len(real) for v in real}


@pytest.mark.parametrize("values", [[], [None, None], [1.0] * 5, [float(i) for i in range(100)]])
def test_ranges_cover_all_rows(spark, values):
    assert split_ranges(scores(spark, values), "a", 4).count() == len(values)


def test_numbers_do_not_depend_on_the_parts(spark):
    rows = spark.range(300).withColumn("g", F.col("id") % 2)
    wanted = hashed_row_number(rows, ["id"], ["g"]).collect()
    assert sorted(wanted) == sorted(hashed_row_number(rows, ["id"], ["g"], digits=3).collect())
    assert hashed_row_number(rows.where("false"), ["id"]).collect() == []
    ranked = value_rank(rows, "g", ["id"]).collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, 301))


def test_curves_without_groups_and_with_nan(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.4), (1, 0.6), (0, float("nan")), (0, 0.1)], "label int, score double")
    roc = evaluation.roc_curve(rows, by=())
    assert roc.columns[0] != "__all" and evaluation.area(roc, "fpr", "tpr").first()["auc"] == pytest.approx(1.0)
    assert evaluation.pr_curve(rows, by=()).count() == 100
    assert evaluation.pr_curve(rows.where("false"), by=()).collect() == []


def test_headers_in_another_order(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\tu\n")
    (tmp_path / "b.tsv").write_text("y\tother\tx\nv\t0\t2\n")
    (tmp_path / "c.tsv").write_text("x\n3\n")
    schema = StructType([StructField("x", LongType()), StructField("y", StringType())])
    got = files.read_tsv(spark, [str(tmp_path / f) for f in ("a.tsv", "b.tsv", "c.tsv")], schema)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "u"), (2, "v"), (3, None)]
    with pytest.raises(Exception):
        files.read_tsv(spark, str(tmp_path), schema).collect()


def test_null_classes_stay(spark):
    rows = spark.createDataFrame([("IGR", "s"), (None, "s"), ("Silent", "Unknown"), ("Silent", None)], "c string, s string")
    kept = rows.where(text.is_coding(F.col("c")) & text.is_placed(F.col("s"))).collect()
    assert [tuple(r) for r in kept] == [(None, "s"), ("Silent", None)]


def test_density_of_large_values(spark):
    base = 1e9
    rows = spark.createDataFrame([("g", base + i / 10) for i in range(50)], "g string, v double")
    low = spark.createDataFrame([("g", i / 10) for i in range(50)], "g string, v double")
    far = {r.grid_index: r.density for r in stats.density(rows, "v", "g", [base, base + 2.5]).collect()}
    near = {r.grid_index: r.density for r in stats.density(low, "v", "g", [0.0, 2.5]).collect()}
    assert far == {k: pytest.approx(v, rel=1e-5) for k, v in near.items()}


def test_named_tables_are_replaced_in_place(spark, tmp_path):
    first = scores(spark, [1.0, 2.0])
    tables.replace_table(first, "edge_table", str(tmp_path / "one"))
    tables.replace_table(spark.table("edge_table").where("a > 1"), "edge_table", str(tmp_path / "two"))
    assert [r.a for r in spark.table("edge_table").collect()] == [2.0]
    tables.replace_table(spark.range(3), "edge_table", str(tmp_path / "three"))
    assert spark.table("edge_table").count() == 3 and spark.table("edge_table").schema["id"].dataType == LongType()
    assert DoubleType() not in [f.dataType for f in spark.table("edge_table").schema]
