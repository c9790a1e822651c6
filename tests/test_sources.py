"""Models, decoders, image folders, logits shapes, interval and receipt details."""

import pytest
from pyspark.sql import functions as F

from kamishi.functions import ctc, geometry
from kamishi.operators import receipts
from kamishi.plans import sql
from kamishi.sources import backends


def test_decoder_of_a_file(spark, tmp_path):
    path = tmp_path / "v.json"
    path.write_text('{"vocabulary": ["", "あ", "い"], "blankIndex": 0}')
    decoder = backends.read_decoder(spark, str(path))
    rows = spark.createDataFrame([([1, 1, 0, 2, 9],)], "i array<int>")
    assert rows.select(decoder.indices(F.col("i")).alias("d")).first().d.text == "あい"
    rows = spark.createDataFrame([([[0.1, 0.8, 0.1], [0.9, 0.0, 0.1], [0.0, 0.4, 0.6]],)], "l array<array<double>>")
    read = rows.select(decoder.logits(F.col("l")).alias("d")).first().d
    assert read.text == "あい" and abs(read.confidence - 0.7) < 1e-9


def test_model_backend(spark, tmp_path):
    """Two regions to an image, the second reads as nothing and drops out."""
    path = tmp_path / "v.json"
    path.write_text('{"vocabulary": ["_", "x", "y"], "blankIndex": 0}')
    decoder = backends.read_decoder(spark, str(path))

    def load():
        def model(batch):
            letter = lambda n: [[0.0, 1.0, 0.0] if n % 2 else [0.0, 0.0, 1.0]]
            box = {"x": 1.0, "y": 2.0, "width": 3.0, "height": 4.0}
            return [[{"obs_id": 0, "logits": letter(n), **box}, {"obs_id": 1, "logits": [[1.0, 0.0, 0.0]], **box}] for n in batch.column("page_id").to_pylist()]

        return model

    images = spark.range(4).select(F.col("id").alias("page_id"), F.lit("n").alias("name"))
    got = backends.by_model(load, decoder.logits)(images).orderBy("page_id").collect()
    assert [(r.page_id, r.obs_id, r.text, r.confidence) for r in got] == [(0, 0, "y", 1.0), (1, 0, "x", 1.0), (2, 0, "y", 1.0), (3, 0, "x", 1.0)]


def test_image_files(spark, tmp_path):
    (tmp_path / "deep" / "er.png").mkdir(parents=True)
    for name in ("a.PNG", "b.jpg", "c.txt", "deep/d.webp", "deep/e.Bmp", "deep/er.png/f.JPEG", "deep/gpng"):
        (tmp_path / name).write_bytes(b"12")
    got = sorted((r.name, r.length, bytes(r.content)) for r in backends.image_files(spark, str(tmp_path)).collect())
    assert got == [(n, 2, b"12") for n in ("a.PNG", "b.jpg", "d.webp", "e.Bmp", "f.JPEG")]
    assert backends.image_files(spark, str(tmp_path), ("txt",)).count() == 1
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError, match="no images"):
        backends.image_files(spark, str(tmp_path / "none"))


def test_constant_is_bounded(spark):
    many = spark.range(backends.MAX_CONSTANT + 1).select(F.col("id").cast("int").alias("obs_id"), F.lit("t").alias("text"), *[F.lit(0.0).alias(c) for c in backends.FIELDS[1:]])
    with pytest.raises(ValueError, match="at most"):
        backends.constant(many)
    images = spark.range(3).select(F.col("id").alias("page_id"))
    assert backends.constant(many.limit(2))(images).count() == 6 and backends.constant(many.limit(0))(images).count() == 0


def test_logits_shapes(spark):
    df = spark.createDataFrame([([[1.0]], [[[1.0]]], [[[1.0]], [[2.0]]], [1.0])], "a array<array<double>>, b array<array<array<double>>>, c array<array<array<double>>>, d array<double>")
    assert df.select(ctc.logits_matrix(df, "a").alias("x")).first().x == df.select(ctc.logits_matrix(df, "b").alias("x")).first().x == [[1.0]]
    with pytest.raises(Exception, match="one sequence"):
        df.select(ctc.logits_matrix(df, "c")).collect()
    with pytest.raises(ValueError, match="depth 1"):
        ctc.logits_matrix(df, "d")


def test_box_of_nothing(spark):
    rows = spark.createDataFrame([([],), ([(1.0, 2.0, 3.0, 4.0), (0.0, 5.0, 1.0, 1.0)],)], "b array<struct<x:double,y:double,width:double,height:double>>")
    assert [tuple(r.z) for r in rows.select(geometry.box_or_zero(F.col("b")).alias("z")).collect()] == [(0, 0, 0, 0), (0, 2, 4, 4)]


def test_unit_prices_go_until_none_is_left(spark):
    lines = ["りんご @120 ¥240", "りんご @@1 2 @@@3 4 5 ¥240", "りんご @ ¥240"]
    rows = spark.createDataFrame([(s,) for s in lines], "s string").select(receipts.parse_item(F.col("s")).alias("i")).collect()
    assert [(r.i.name, r.i.price) for r in rows] == [("りんご", 240), ("りんご", 240), ("りんご @", 240)]


def test_sql_functions(spark):
    assert "page_lines" in sql.register(spark)
    row = spark.sql("SELECT normalize_text('　ｶﾞ　 Ａ \\n ｘ　') AS a, classify_region(16, 1) AS b, overlap_ratio(0, 4, 2, 10) AS c, interval_gap(0, 1, 3, 4) AS d").first()
    assert tuple(row) == ("ガ A\nx", "horizontal", 0.5, 2.0)


def test_receipts_take_one_exchange(spark, tmp_path):
    """Lines from a file are dealt out by document once; a blank line does not end a pending amount."""
    rows = [(1, 0, "合計"), (1, 1, ""), (1, 2, " "), (1, 3, "¥514"), (2, 0, ""), (2, 1, "¥100"), (3, 0, "小計"), (3, 1, "x"), (3, 2, "¥7")]
    spark.createDataFrame(rows, "doc_id long, line_no int, line string").write.parquet(f"{tmp_path}/lines")
    done = receipts.extract(spark.read.parquet(f"{tmp_path}/lines"))
    assert done._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.doc_id: (r.total, r.subtotal) for r in done.collect()} == {1: (514, None), 2: (None, None), 3: (None, None)}
