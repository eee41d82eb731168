"""Counts kept by a stream equal those of one batch job."""

from pyspark.sql import functions as F

from cellspan.streaming import counts


def test_counts_follow_arrivals(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    arrive = str(tmp_path / "in")
    keys = [F.col("l_returnflag"), F.floor(F.col("l_quantity") / 10).alias("bin")]
    for share in (0, 1):
        rows.where(F.col("l_orderkey") % 2 == share).repartition(2).write.mode("append").parquet(arrive)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(arrive)
        query = counts.count_stream(stream, keys, str(tmp_path / "out"), str(tmp_path / "state"))
        assert query.awaitTermination(60)
    got = {tuple(r) for r in counts.totals(spark, str(tmp_path / "out")).select("l_returnflag", "bin", "n").collect()}
    assert got == {tuple(r) for r in rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()}
