"""Rows keep their names however a scan is cut: what runs between two reads must not change a result."""

from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import corpus_pipeline
from rallyline.llm import common, passages

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """Documents over 24 files, of which several make one task, or one task each."""
    path = str(tmp_path_factory.mktemp("rows") / "documents.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)).repartition(24).write.parquet(path)
    return spark.read.parquet(path)


CUT = ("spark.sql.files.openCostInBytes", "spark.sql.leafNodeDefaultParallelism")


@pytest.fixture(autouse=True)
def cut_as_before(spark):
    yield
    for name in CUT:
        spark.conf.unset(name)


def tasks(spark, n):
    for name, value in zip(CUT, ("1", str(n)), strict=True):
        spark.conf.set(name, value)


def test_row_keys_do_not_move(spark, many_files):
    keys = []
    for n in (1, 40):
        tasks(spark, n)
        rows = common.numbered(common.settled(many_files))
        keys.append(({tuple(r[common.ROW]): r["doc_id"] for r in rows.collect()}, rows.rdd.getNumPartitions()))
    assert keys[0][0] == keys[1][0] and len(keys[0][0]) == 400 and keys[0][1] != keys[1][1]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]] + ["passages"])
def test_stages_agree_whatever_the_parallelism(spark, many_files, name):
    stage = dict(corpus_pipeline.STAGES).get(name, lambda spark, docs, sf_dir: passages.without_repeats(docs))
    found = []
    for first, second in ((1, 1), (1, 40), (40, 3)):
        tasks(spark, first)
        out = stage(spark, many_files, DATA)
        tasks(spark, second)  # an executor came or went
        found.append(Counter(tuple(r) for r in out.select("doc_id", F.md5("text"), "lang").collect()))
    assert found[0] == found[1] == found[2] and 10 < found[0].total() <= 800


def test_what_is_no_plain_scan_is_stored_first(spark, many_files):
    assert common.settled(many_files) is many_files
    mapped = many_files.where("doc_id > 3").select("doc_id", F.upper("text").alias("text"))
    assert common.settled(mapped) is mapped
    twice = many_files.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    others = [twice, many_files.limit(5), many_files.where(F.rand() < 0.5), many_files.repartition(3), spark.range(3), many_files.join(twice, "doc_id")]
    for df in others:
        rows = common.numbered(common.settled(df))
        assert rows.select(common.ROW).distinct().count() == rows.count() > 0
    clash = many_files.withColumn("_metadata", F.lit(1))
    assert common.numbered(common.settled(clash)).select(common.ROW).distinct().count() == 400
    with pytest.raises(PySparkException):
        common.numbered(spark.range(3))
