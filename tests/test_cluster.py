import os

import pyarrow as pa
from pyspark.sql import functions as F

from docgrain import cluster


def test_written_tables_and_clean(spark):
    cluster.clean(spark)
    table = cluster.written(spark.range(7), "numbers")
    folder = spark.sparkContext._docgrain_dirs[0].removeprefix("file://")
    assert os.path.isdir(folder) and table.count() == 7
    assert cluster.clean(spark) == 1 and not os.path.isdir(folder) and cluster.clean(spark) == 0


def test_clean_leaves_what_is_read(spark):
    before = cluster.made(spark)
    one, two = (cluster.written(spark.range(5), name) for name in ("one", "two"))
    new = [x for x in cluster.made(spark) if x not in before]
    assert len(new) == 2 and cluster.clean(spark, new, but=one.where("id > 2")) == 1
    assert one.count() == 5 and cluster.made(spark) == [*before, new[0]]
    assert cluster.clean(spark, new) == 1 and cluster.made(spark) == before


def test_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert cluster.spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == cores
    wide = spark.range(100).repartition(cores + 3)
    assert cluster.spread(wide) is wide


def test_local_sessions_get_one_shared_folder(spark):
    assert cluster.shared_dir(spark) == cluster.shared_dir(spark)
    assert os.path.isdir(cluster.shared_dir(spark).removeprefix("file://").removeprefix("file:"))


def test_executors_get_the_package(spark):
    def work(batches):
        from docgrain.functions import fixed

        for batch in batches:
            assert fixed.TOKEN
            yield batch

    assert cluster.map_arrow(spark.range(3), work, "id long").count() == 3


def test_batches_are_bounded_by_rows_and_bytes(spark):
    session = spark.newSession()
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    session.conf.set(size, "64m")
    cluster.ship(session)
    assert int(session.conf.get(rows)) == cluster.BATCH_ROWS and int(session.conf.get(size)) == cluster.BATCH_BYTES
    session.conf.set(rows, "10")
    session.conf.set(size, "1m")
    cluster.ship(session)
    assert session.conf.get(rows) == "10" and session.conf.get(size) == "1m"

    def widths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    big = session.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 500_000).alias("t"))
    session.conf.set(rows, "1000")
    assert max(r.n for r in cluster.map_arrow(big, widths, "n long").collect()) <= 4
