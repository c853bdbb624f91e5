"""The data source of feed documents: what is read, where, and once."""

import os

import pytest
from pyspark.sql import functions as F

from vicinity.sources.datasource import FeedReader, FeedSource, FeedStream

ITEM = "<rss><channel><item><guid>{0}</guid><title>T {0}</title></item><item><guid>{0}-2</guid><title>U & V</title></item></channel></rss>"


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(FeedSource)
    (tmp_path / "in").mkdir()
    for n in ("a", "b", "c"):
        (tmp_path / f"in/{n}.xml").write_text(ITEM.format(n))
    return tmp_path


def _stream(spark, folder, **options):
    stream = spark.readStream.format("feed_documents").options(**options).load(f"{folder}/in")
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(once=True).start().awaitTermination()
    return sorted(r["guid"] for r in spark.read.parquet(f"{folder}/out").collect())


def test_a_file_that_was_finished_long_ago_and_moved_in_late_is_read(spark, folder):
    assert _stream(spark, folder) == ["a", "a-2", "b", "b-2", "c", "c-2"]
    late = folder / "z.xml"
    late.write_text(ITEM.format("z"))
    os.utime(late, (1, 1))
    late.rename(folder / "in/0.xml")
    assert _stream(spark, folder) == ["a", "a-2", "b", "b-2", "c", "c-2", "z", "z-2"]
    assert len(_stream(spark, folder)) == 8


def test_read_files_are_archived_and_not_read_again(spark, folder):
    for n in ("d", "e", "f"):
        got = _stream(spark, folder, archive=f"{folder}/done")
        (folder / f"in/{n}.xml").write_text(ITEM.format(n))
    got = _stream(spark, folder, archive=f"{folder}/done")
    assert got == sorted(x for n in "abcdef" for x in (n, f"{n}-2"))
    assert {"a.xml", "b.xml", "c.xml"} <= set(os.listdir(folder / "done")) and not (folder / "in/a.xml").exists()


def test_files_are_partitions_and_a_source_filter_chooses_them(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("feed_documents").option("pushdown", "true").load(f"{folder}/in")
    assert rows.rdd.getNumPartitions() == 3
    some = rows.where(F.col("source_name").isin("a", "c") & (F.length("title") > 3))
    assert sorted(r["guid"] for r in some.collect()) == ["a-2", "c-2"]
    assert some.rdd.getNumPartitions() == 2 and rows.where("source_name = 'b'").count() == 2 and rows.where("source_name = 'nix'").count() == 0
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_offsets_are_listings(folder):
    s = FeedStream({"path": f"{folder}/in", "sources": "a, c"})
    end = s.latestOffset()
    assert end == {"names": ["a.xml", "c.xml"]} and [p.path for p in s.partitions({"names": ["a.xml", "gone.xml"]}, end)] == ["c.xml"]
    assert s.partitions(end, {"names": []}) == [] and list(FeedReader({"path": f"{folder}/in"}).read(None)) == []
