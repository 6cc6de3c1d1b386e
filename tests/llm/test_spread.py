from pyspark.sql import functions as F

from photolith.llm._bytes import spread


def test_few_splits_are_dealt_over_all_cores_and_many_are_left(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    rows = [(i, "a text" if i % 3 else None) for i in range(500)] + [(7, "a text")] * 2
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    dealt = spread(one)
    assert dealt.select(F.spark_partition_id()).distinct().count() == cores
    assert sorted(map(tuple, dealt.collect()), key=str) == sorted(rows, key=str)
    many = spark.range(0, 10, 1, cores)
    assert spread(many) is many
    assert spread(one.filter("false")).count() == 0
