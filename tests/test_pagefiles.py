"""Observation files with pushed filters; page files all or none."""

import json
import os

import pytest
from pyspark.sql import functions as F

from kamishi.sources import pagefiles


def write_pages(folder, pages):
    for name, lines in pages.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(json.dumps(x) if isinstance(x, dict) else x for x in lines) + "\n")


def box(text, x=0, confidence=None):
    return {"text": text, "x": x, "y": 1, "width": 2.5, "height": 3} | ({} if confidence is None else {"confidence": confidence})


PAGES = {"a.jsonl": [{"page_id": 1, "boxes": [box("左", 0, 0.9), box("右", 5, 0.2)]}, "", {"page_id": 2, "boxes": []}], "deep/b.jsonl": [{"page_id": 3, "boxes": [box(None), box("x", 1, 0.5)]}], "_skipped": ["no page"]}


def test_observations(spark, tmp_path):
    pagefiles.register(spark)
    write_pages(tmp_path, PAGES)
    df = spark.read.format("observations").option("partitionBytes", 10).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 2
    assert [tuple(r) for r in df.orderBy("page_id", "obs_id").collect()] == [
        (1, 0, "左", 0.0, 1.0, 2.5, 3.0, 0.9), (1, 1, "右", 5.0, 1.0, 2.5, 3.0, 0.2), (3, 0, None, 0.0, 1.0, 2.5, 3.0, 1.0), (3, 1, "x", 1.0, 1.0, 2.5, 3.0, 0.5),
    ]
    found = df.where("page_id IN (1, 2) AND confidence >= 0.5 AND length(text) = 1")
    plan = found._jdf.queryExecution().executedPlan().toString()
    left = plan.split("Filter")[1].split("\n")[0]
    assert "length(text" in left and ">=" not in left and "page_id" not in left  # only that comparison is left to Spark
    assert [(r.page_id, r.text) for r in found.collect()] == [(1, "左")]
    assert [(r.page_id, r.obs_id) for r in df.where("page_id > 1 AND confidence < 1").collect()] == [(3, 1)]
    assert df.where("page_id = 7").count() == 0 and df.where("confidence IS NULL").count() == 0


def test_pushed_filters(tmp_path):
    """Pages and boxes that fail never become rows; what is not understood goes back to Spark."""
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, StringContains

    write_pages(tmp_path, PAGES)
    reader = pagefiles.ObservationReader(str(tmp_path), 1 << 20)
    other = StringContains(("text",), "x")
    assert list(reader.pushFilters([EqualTo(("page_id",), 3), GreaterThanOrEqual(("confidence",), 0.9), other])) == [other]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1


def test_bad_lines(spark, tmp_path):
    pagefiles.register(spark)
    write_pages(tmp_path, {"a.jsonl": [{"page_id": 1, "boxes": []}, '{"page_id": 2}']})
    with pytest.raises(Exception, match="line 2: no page"):
        spark.read.format("observations").load(str(tmp_path)).collect()
    (tmp_path / "none").mkdir()
    assert spark.read.format("observations").load(str(tmp_path / "none")).count() == 0


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder).split("/", 1)[1] for d, _, names in os.walk(folder) for f in names)


def test_page_files(spark, tmp_path):
    pagefiles.register(spark)
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("a/b", "# x\n"), ("c", None), ("d", "é" * 10)], "page_id string, content string").repartition(3)
    df.write.format("page_files").option("suffix", "md").mode("append").save(out)
    assert files(out) == ["a%2Fb.md", "c.md", "d.md"]
    back = spark.read.option("recursiveFileLookup", True).text(out, wholetext=True)
    assert sorted(r.value for r in back.collect()) == ["# x\n", "é" * 10] or sorted(r.value for r in back.collect()) == ["", "# x\n", "é" * 10]
    df.limit(1).withColumn("page_id", F.lit("e")).write.format("page_files").option("suffix", "json").mode("append").save(out)
    assert [f for f in files(out) if f.endswith("json")] == ["e.json"] and len(files(out)) == 4
    df.where("page_id = 'd'").write.format("page_files").mode("overwrite").save(out)
    assert files(out) == ["d.md"]


def test_failed_job_leaves_nothing(spark, tmp_path):
    pagefiles.register(spark)
    out = str(tmp_path / "out")
    good = spark.range(40).select(F.col("id").alias("page_id"), F.lit("x").alias("content"))
    good.write.format("page_files").mode("append").save(out)
    broken = good.repartition(4, "page_id").withColumn("content", F.when(F.col("page_id") == 39, F.raise_error(F.lit("broken"))).otherwise("y"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            broken.write.format("page_files").mode(mode).save(out)
        assert len(files(out)) == 40 and not any(n.startswith("_staging") for n in os.listdir(out))
    with pytest.raises(Exception, match="needs the columns"):
        good.drop("content").write.format("page_files").mode("append").save(out)


def test_attempt_outlives_job(tmp_path):
    """Spark aborts a job, and commits it, before every killed or speculative attempt has ended."""
    import pyarrow as pa

    batch = pa.record_batch({"page_id": [1, 2], "content": ["x", "y"]})

    def late(end, before):
        yield from [batch] * before
        end()
        yield pa.record_batch({"page_id": [3], "content": ["z"]})

    for end in ("abort", "commit"):
        for before in (0, 1):
            writer = pagefiles.PageFiles({"path": str(tmp_path)}).writer(pa.schema(batch.schema), False)
            done = writer.write(iter([batch]))
            with pytest.raises(RuntimeError, match="has ended"):
                writer.write(late(lambda: getattr(writer, end)([done]), before))  # noqa: B023
            assert not any(n.startswith("_staging") for n in os.listdir(tmp_path))
    assert files(tmp_path) == ["1.md", "1.md", "2.md", "2.md"]  # of the two commits


def test_nothing_left_of_queries(spark, tmp_path):
    """Neither planning a write nor a query that fails before its last stage leaves a staging folder."""
    pagefiles.register(spark)
    out = str(tmp_path / "out")
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.when(F.col("id") == 39, F.raise_error(F.lit("broken"))).otherwise("y").alias("content"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            pages.repartition(4, "content").write.format("page_files").mode(mode).save(out)
    assert not os.path.exists(out) or os.listdir(out) == []
