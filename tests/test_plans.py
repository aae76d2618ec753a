"""What the optimiser makes of the operators that must stay cheap."""

import pytest
from pyspark.sql import functions as F

from oosgauge.catalog.base import embeddings, table
from oosgauge.functions.draws import shuffled_position
from oosgauge.operators import fuzzy as Z
from oosgauge.operators.knn import knn
from oosgauge.plans import reports as R
from oosgauge.sources import staged as S

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_are_limited_before_the_shuffle(spark):
    text = plan(knn(embeddings(spark, SF), 5, collapse=True))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_block_passes_have_no_pair_join(spark):
    text = plan(knn(embeddings(spark, SF), 5, collapse=False))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "REPARTITION_BY_NUM" in text


def test_repository_limits_hubs_before_ranking(spark):
    g = spark.createDataFrame([(0, 1, 0.5)], "i bigint, j bigint, w double")
    assert "WindowGroupLimit" in plan(Z.neighbor_repository(g, 10, 5, 1))


def test_scans_read_only_what_they_need(spark):
    li = table(spark, SF, "lineitem")
    text = plan(R.n_classes(li.select(F.col("l_returnflag").alias("label"))))
    assert "ReadSchema: struct<l_returnflag:string>" in text


def test_stage_filters_prune_directories(spark, tmp_path):
    from oosgauge.operators.prep import proportion_stages

    cu = table(spark, SF, "customer").select(
        F.lit("c").alias("dataset"), F.col("c_custkey").alias("id"), F.array("c_acctbal").alias("features"),
        F.col("c_mktsegment").alias("label"),
    )
    path = str(tmp_path / "staged")
    S.write_staged(proportion_stages(cu, 3), path)
    text = plan(S.read_staged(spark, path, "c", stage=1))
    assert "stage" in text.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert S.read_staged(spark, path, "c", stage=1).count() == cu.count()


@pytest.mark.parametrize("group", [[], ["c_mktsegment"]])
def test_positions_never_use_one_window_for_a_group(spark, group):
    cu = table(spark, SF, "customer")
    text = plan(shuffled_position(cu, "c_custkey", 3, group))
    numbering = [line for line in text.splitlines() if "row_number" in line and "Window" in line]
    assert numbering and all("_slice" in line for line in numbering)
