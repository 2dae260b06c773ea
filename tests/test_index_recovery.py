"""Writes of the index that are repeated or cut off, and how much a read of one name opens."""

import pytest
from pyspark.sql import functions as F

from docweave.sources import index as I
from docweave.sources.index import clear_names, read_index, replace_documents, stored_shards, write_index


def rows(spark, names, per=3, tag=""):
    return spark.createDataFrame([(n, p, f"{tag}{n}-{p}", [float(p)]) for n in names for p in range(per)],
                                 "name string, pos long, text string, embedding array<float>")


def content(spark, path):
    return sorted((r.name, r.pos, r.text) for r in read_index(spark, path).collect())


class Stop(Exception):
    pass


def stop_at(monkeypatch, name, after=0):
    """The function ``name`` of the index module fails at its call number ``after``."""
    real, calls = getattr(I, name), []

    def failing(*args, **kwargs):
        calls.append(1)
        if len(calls) > after:
            raise Stop
        return real(*args, **kwargs)

    monkeypatch.setattr(I, name, failing)


def test_a_repeated_append_adds_its_rows_once(spark, tmp_path):
    path = str(tmp_path / "index")
    for _ in range(3):
        write_index(rows(spark, ["a", "b"], 2), path, shards=4, write_id="w1")
    assert content(spark, path) == [("a", 0, "a-0"), ("a", 1, "a-1"), ("b", 0, "b-0"), ("b", 1, "b-1")]
    write_index(rows(spark, ["a"], 2, "new "), path, write_id="w2")
    write_index(rows(spark, ["a"], 1, "free "), path)
    assert [r for r in content(spark, path) if r[0] == "a"] == [
        ("a", 0, "a-0"), ("a", 1, "a-1"), ("a", 2, "new a-0"), ("a", 3, "new a-1"), ("a", 4, "free a-0")]


def test_an_append_cut_off_before_its_mark_is_finished_by_the_retry(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    write_index(rows(spark, ["a"], 2), path, shards=4, write_id="w1")
    stop_at(monkeypatch, "_put")  # the rows are stored, the mark is not
    with pytest.raises(Stop):
        write_index(rows(spark, ["a", "b", "c"], 2, "x"), path, write_id="w2")
    monkeypatch.undo()
    whole = content(spark, path)
    # some of the files are lost again, as after a commit that broke off
    lost = next(f for f in sorted((tmp_path / "index").rglob("*.parquet")) if spark.read.parquet(str(f)).filter(
        "text like 'x%'").count() and "name" in spark.read.parquet(str(f)).columns and not spark.read.parquet(
        str(f)).filter("text not like 'x%'").count())
    lost.unlink()
    assert len(content(spark, path)) < len(whole)
    write_index(rows(spark, ["a", "b", "c"], 2, "x"), path, write_id="w2")
    assert content(spark, path) == whole


@pytest.mark.parametrize("step", ["finish_pending", "_write_layout", "_delete"])
def test_an_overwrite_cut_off_anywhere_is_whole(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "index")
    write_index(rows(spark, ["a", "b", "c"], 3), path, shards=4)
    stop_at(monkeypatch, step, after=1 if step == "finish_pending" else 0)
    with pytest.raises(Stop):
        write_index(rows(spark, ["d"], 2), path, shards=2, mode="overwrite")
    monkeypatch.undo()
    assert content(spark, path) == [("d", 0, "d-0"), ("d", 1, "d-1")]
    assert stored_shards(spark, path) == 2
    assert not I.path_exists(spark, I.pending_path(path))
    write_index(rows(spark, ["d"], 1), path)
    assert len(content(spark, path)) == 3


@pytest.mark.parametrize("step", ["_write_layout", "_delete"])
def test_a_change_of_some_documents_cut_off_is_whole(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "index")
    write_index(rows(spark, ["a", "b", "c", "d"], 2), path, shards=3)
    stop_at(monkeypatch, step)
    with pytest.raises(Stop):
        replace_documents(spark, path, rows(spark, ["a", "e"], 1, "new "))
    monkeypatch.undo()
    assert content(spark, path) == [("a", 0, "new a-0"), ("b", 0, "b-0"), ("b", 1, "b-1"), ("c", 0, "c-0"),
                                    ("c", 1, "c-1"), ("d", 0, "d-0"), ("d", 1, "d-1"), ("e", 0, "new e-0")]
    clear_names(spark, path, spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "name string"))
    assert content(spark, path) == []


def test_a_read_of_one_name_opens_few_row_groups(spark, tmp_path):
    """100,000 names in small row groups: a name that falls between others of every group is kept out by the filters."""
    import pyarrow.parquet as pq
    path = str(tmp_path / "index")
    names = spark.range(100_000).select(F.md5(F.col("id").cast("string")).alias("name"), F.lit(0).cast("bigint").alias("pos"),
                                        F.lit("t").alias("text"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    hadoop = spark._jsc.hadoopConfiguration()
    before = hadoop.get("parquet.block.size")
    hadoop.set("parquet.block.size", str(64 << 10))
    try:
        write_index(names, path, shards=2)
        write_index(names.withColumn("pos", F.lit(5).cast("bigint")), path)  # every shard has several sorted files
    finally:
        if before is None:
            hadoop.unset("parquet.block.size")
        else:
            hadoop.set("parquet.block.size", before)
    files = sorted((tmp_path / "index").rglob("*.parquet"))
    meta = [pq.ParquetFile(f).metadata for f in files]
    groups = sum(m.num_row_groups for m in meta)
    assert groups > 20
    column = [i for i in range(meta[0].num_columns) if meta[0].row_group(0).column(i).path_in_schema == "name"][0]
    wanted = names.filter("name > '80'").orderBy("name").first().name
    read = read_index(spark, path, [wanted])
    # one name, twice; its row groups are those whose statistics and filter allow it
    assert read.count() == 2
    holding = sum(m.row_group(g).column(column).statistics.min <= wanted <= m.row_group(g).column(column).statistics.max
                  for m in meta for g in range(m.num_row_groups))
    assert holding <= 4
    assert all(_has_bloom(spark, str(f)) for f in files)


def _has_bloom(spark, file):
    """Whether the file's footer names a bloom filter for ``name``."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        columns = reader.getFooter().getBlocks().get(0).getColumns()
        return any(columns.get(i).getPath().toDotString() == "name" and columns.get(i).getBloomFilterOffset() > 0
                   for i in range(columns.size()))
    finally:
        reader.close()
