"""Receipts line by line against the batch operator."""

import datetime
import random

from kamishi.operators.receipts import extract
from kamishi.streaming.receipts import receipt_stream

LINES = "doc_id long, time timestamp, line_no int, line string"
START = datetime.datetime(2024, 1, 1)


def receipt(r, n):
    items = [f"商品{i} ¥{r.randint(10, 999)}" for i in range(n)]
    return ["さくら商店", "2024年1月5日 12:34", *items, f"小計 ¥{r.randint(100, 9999)}", "合計", f"¥{r.randint(100, 9999)}", "お預り ¥10,000", "お釣り ¥1"]


def fields(rows):
    return sorted((str({k: v for k, v in x.asDict(recursive=True).items() if k != "opened"}) for x in rows))


def test_lines_in_any_order_give_the_receipts_of_the_batch(spark, tmp_path):
    r = random.Random(2)
    at = lambda s: START + datetime.timedelta(seconds=s)
    rows = [(d, at(d * 2 + no), no, line) for d in range(30) for no, line in enumerate(receipt(r, r.randint(0, 6)))]
    rows += [rows[3], (None, at(5), 0, "合計 ¥5"), (4, None, 0, "合計 ¥5")]  # a repeated line; lines that belong to no receipt
    r.shuffle(rows)
    later = [(100, at(7200), 0, "合計 ¥700"), (3, at(7201), 0, "合計 ¥701")]  # doc_id 3 once more, hours after
    late = [(7, at(30), 99, "合計 ¥1")]  # the watermark has passed it
    end = [(101, at(14400), 0, "合計 ¥9")]
    batches = [*[rows[i::4] for i in range(4)], later, late, end]
    held, source = [], tmp_path / "in"
    source.mkdir()
    lines = spark.readStream.schema(LINES).parquet(str(source))
    query = receipt_stream(lines, lambda done: held.append(done.collect()), str(tmp_path / "state"))
    try:
        closed = []
        for b in batches:
            spark.createDataFrame(b, LINES).coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
            closed.append(sum(map(len, held)))
        state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        query.stop()
    assert closed[:4] == [0, 0, 0, 0] and closed[4:] == [30, 30, 32]  # open until the watermark passes; the late line adds nothing
    assert state == 1
    batch = lambda part: extract(spark.createDataFrame([(d, no, line) for d, t, no, line in part if d is not None and t is not None], "doc_id long, line_no int, line string")).collect()
    got = [x for part in held for x in part]
    assert fields(x for x in got if x.opened < at(3600)) == fields(batch(rows))
    assert fields(x for x in got if x.opened >= at(3600)) == fields(batch(later))
