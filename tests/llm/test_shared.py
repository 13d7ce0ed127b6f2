import time

from pyspark.sql import functions as F

from barline.llm import jaccard_join, shared


def _shuffle_files(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(shared.CLEANUP, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")).repartition(3, "s")
    table = shared.written(df, "tidy")
    until = time.time() + 10
    while (left := _shuffle_files(spark)) > before and time.time() < until:
        time.sleep(0.1)
    assert left <= before
    assert {(r.k, r.s) for r in table.collect()} == {(k, sum(range(k, 1000, 7))) for k in range(7)}
    assert spark.conf.get(shared.CLEANUP, None) == setting


def _tables(spark) -> set[str]:
    jvm, at = spark.sparkContext._jvm, f"{shared.shared_dir(spark)}/barline/{spark.sparkContext.applicationId}"
    path = jvm.org.apache.hadoop.fs.Path(at)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {x.getPath().getName() for x in found.listStatus(path)} if found.exists(path) else set()


def test_tables_between_steps_go_but_for_the_last(spark):
    before = _tables(spark)
    with shared.tables_dropped(spark) as made:
        one = shared.written(spark.range(5), "one")
        with shared.tables_dropped(spark):
            two = shared.written(shared.written(one, "lost").where("id > 1"), "two")
        assert {x.rpartition("-")[0] for x in _tables(spark) - before} == {"one", "two"}
        three = shared.written(one.join(two, "id"), "three")
    assert {x.rpartition("-")[0] for x in _tables(spark) - before} == {"three"} and len(made) == 1
    assert sorted(r.id for r in three.collect()) == [2, 3, 4]


def test_near_duplicates_leave_their_rows_and_classes_only(spark):
    before = _tables(spark)
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 2}_{k}" for k in range(40 + i % 2))) for i in range(20)], "doc_id long, text string")
    got = jaccard_join.jaccard_classes(docs)
    assert {x.rpartition("-")[0] for x in _tables(spark) - before} == {"shingle-documents", "labels"}
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(i, i - i % 2) for i in range(20)}
