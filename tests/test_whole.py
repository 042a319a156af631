"""Queries keep what small fixtures can't show to be lost."""

from pyspark.sql import functions as F

from sparkloom import plans
from sparkloom.plans import keyed


def test_pop_keeps_a_long_list(spark, monkeypatch):
    one = spark.range(1).select(F.col("id").alias("k"), F.sequence(F.lit(1), F.lit(1_000_003)).cast("array<string>").alias("l"))
    monkeypatch.setattr(keyed, "users", lambda spark, sf_dir: one)
    got = plans.QUERIES["llist_pop"](spark, "").select(F.size(F.split("v", ",")).alias("n"), F.right("v", F.lit(7)).alias("end")).first()
    assert tuple(got) == (1_000_002, "1000003")
