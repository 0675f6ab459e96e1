"""Indexed tables against filters on the rows, and how many files they have and open."""

import os

import pytest
from pyspark.sql import functions as F

from quillwave.sources import indexed as X


@pytest.fixture(scope="module")
def rows(spark):
    """3,000 jobs with two short stems each, one job with a third of all rows, null keys."""
    jobs = spark.range(3000).select(F.col("id").alias("job_id"), F.explode(F.array(F.lit("music"), F.lit("voice"))).alias("stem")).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(1))))
    hot = spark.range(6000).select(F.lit(700).cast("long").alias("job_id"), F.lit("hot").alias("stem"), F.col("id").cast("int").alias("pos"))
    odd = spark.createDataFrame([(None, "voice", 1), (5, None, 2), (None, None, 3)], "job_id long, stem string, pos int")
    return jobs.unionByName(hot).unionByName(odd).withColumn("value", F.col("pos") * 0.5).cache()


@pytest.fixture(scope="module")
def path(rows, tmp_path_factory):
    folder = f"{tmp_path_factory.mktemp('indexed')}/t"
    X.write_stem_table(rows, folder, files=12)
    return folder


def same(got, want):
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_files_do_not_follow_the_number_of_jobs(spark, rows, path):
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    index = X.read_index(spark, path).orderBy("low").collect()
    assert len(files) == len(index) <= 12 and sum(r.rows for r in index) == rows.count()
    assert sum(r.low.job_id == 700 and r.high.job_id == 700 for r in index) >= 2  # the hot job is cut
    same(spark.read.parquet(path), rows)


def test_one_key_opens_its_files_only(spark, rows, path):
    got = X.read_key(spark, path, job_id=1234, stem="voice")
    same(got, rows.filter("job_id = 1234 AND stem = 'voice'"))
    assert len(X.files_between(spark, path, {"job_id": 1234, "stem": "voice"}, {"job_id": 1234, "stem": "voice"})) <= 2
    same(X.read_key(spark, path, job_id=700, stem="hot"), rows.filter("job_id = 700 AND stem = 'hot'"))
    same(X.read_key(spark, path, job_id=5), rows.filter("job_id = 5"))


def test_ranges_nulls_and_absent_keys(spark, rows, path):
    same(X.read_between(spark, path, {"job_id": 690}, {"job_id": 702}), rows.filter("job_id BETWEEN 690 AND 702"))
    same(X.read_between(spark, path, {"job_id": 2990, "stem": "voice"}), rows.filter("job_id > 2990 OR job_id = 2990 AND stem >= 'voice'"))
    same(X.read_between(spark, path), rows)
    same(X.read_key(spark, path, job_id=None), rows.filter("job_id IS NULL"))
    same(X.read_key(spark, path, job_id=5, stem=None), rows.filter("job_id = 5 AND stem IS NULL"))
    assert X.read_key(spark, path, job_id=99_999).count() == 0 and X.files_between(spark, path, {"job_id": 99_999}) == []


def test_empty_table_and_cut_files(spark, rows, tmp_path):
    X.write_stem_table(rows.limit(0), f"{tmp_path}/e")
    assert X.read_key(spark, f"{tmp_path}/e", job_id=1).count() == 0 and X.read_index(spark, f"{tmp_path}/e").count() == 0
    X.write_indexed(rows, f"{tmp_path}/c", ["stem"], ["job_id"], files=1, rows_per_file=1000)
    index = X.read_index(spark, f"{tmp_path}/c").collect()
    assert len(index) == 19 and max(r.rows for r in index) == 1000
    same(X.read_key(spark, f"{tmp_path}/c", stem="hot"), rows.filter("stem = 'hot'"))
    signal = rows.select(F.lit("a").alias("series_id"), F.col("pos").cast("long").alias("pos"), "value")
    X.write_chunk_table(signal, f"{tmp_path}/s", 1, files=3)
    same(X.read_key(spark, f"{tmp_path}/s", series_id="a", chunk_id=2).drop("chunk_id"), signal.filter("pos BETWEEN 40 AND 59"))
