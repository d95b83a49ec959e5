import pytest
from pyspark.sql import functions as F

from echoloom.operators.stages import Stage, run_stages


def test_stages(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, name string")
    upper = lambda df: df.withColumn("name", F.upper("name"))
    stages = [
        Stage("upper", upper, valid=F.col("name").isNotNull(), keep_invalid=True),
        Stage("many", lambda df: df.limit(0), condition=F.count("*") > 3),
        Stage("off", lambda df: df.limit(0), enabled=False),
        Stage("double", lambda df: df.withColumn("id", F.col("id") * 2), condition=F.max("id") == 3, finish=lambda df: df.orderBy("id"), after=("upper",)),
        Stage("named", lambda df: df, valid=F.col("name") > ""),
    ]
    out, said = run_stages(rows, stages)
    assert said == {"upper": "taken", "many": "skipped", "off": "disabled", "double": "taken", "named": "taken"}
    assert sorted(map(tuple, out.collect())) == [(2, "A"), (6, "B")]
    empty, said = run_stages(rows.where("false"), stages[:4])
    assert said["double"] == "skipped" and empty.count() == 0


def test_stages_that_do_not_fit(spark):
    rows = spark.range(3)
    same = lambda df: df
    with pytest.raises(ValueError, match="needs first"):
        run_stages(rows, [Stage("first", same, condition=F.count("*") > 9), Stage("next", same, after=("first",))])
    with pytest.raises(ValueError, match="two stages"):
        run_stages(rows, [Stage("a", same), Stage("a", same)])
