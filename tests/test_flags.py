"""One-hot flags of a great many names."""

from pyspark.sql import functions as F

from airspan.plans import features


def test_the_slot_of_a_flag_is_read_without_writing_the_vector_out(spark):
    names = [f"s{i}" for i in range(20_000)]
    asked = ["s0", "s1", "s19999", "unknown", None]
    rows = spark.createDataFrame([(n,) for n in asked * 200], "name string").coalesce(1)
    flagged = features.one_hot(rows, "name", names)
    found = flagged.select("name", features.flag_slot(F.col("station_flags")).alias("slot"))
    # Written out, a row alone would take 160 kB.
    assert "vector_to_array" not in found._jdf.queryExecution().toString()
    assert {r["name"]: r["slot"] for r in found.collect()} == {"s0": 0, "s1": 1, "s19999": 19999, "unknown": 0, None: 0}
