"""Fills and running sums over bands against plain Python; chunks and profiles of every format."""

import json
import random

import pytest
from pyspark.sql import functions as F

from umbral.functions import detect, text
from umbral.operators import bands, metrics, stats
from umbral.operators import frame as X
from umbral.sources import files

ROWS = [(i, f"k{i % 7}", None if random.Random(i).random() < 0.6 else float(i)) for i in range(500)]


@pytest.mark.parametrize("by", ["i", ["s", "i"]])
@pytest.mark.parametrize("way", ["forward", "backward"])
def test_fill(spark, by, way):
    df = spark.createDataFrame(ROWS, "i int, s string, v double").repartition(9)
    want, last = {}, None
    rows = sorted(ROWS, key=lambda r: r[0] if by == "i" else (r[1], r[0]))
    for i, _, v in rows if way == "forward" else rows[::-1]:
        last = last if v is None else v
        want[i] = last
    out = X.fill_null(df, way, order_by=by, columns=["v"])
    assert out.columns == df.columns
    assert {r["i"]: r["v"] for r in out.collect()} == want


def test_fill_edges(spark):
    empty = spark.createDataFrame([], "i int, v double")
    assert X.fill_null(empty, "forward", order_by="i", columns=["v"]).count() == 0
    nulls = spark.createDataFrame([(None, 1.0), (2, None), (3, None)], "i int, v double")
    assert {r["i"]: r["v"] for r in X.fill_null(nulls, "forward", order_by="i").collect()} == {None: 1.0, 2: 1.0, 3: 1.0}
    none = spark.createDataFrame([(1, None), (2, None)], "i int, v double")
    assert [r["v"] for r in X.fill_null(none, "backward", order_by="i", columns=["v"]).collect()] == [None, None]
    read = spark.range(0, 100, 1, 7).select("id", F.when(F.col("id") % 9 == 4, F.col("id")).alias("v"))
    got = {r["id"]: r["v"] for r in X.fill_null(read, "forward", columns=["v"]).collect()}
    assert got == {i: None if i < 4 else (i - 4) // 9 * 9 + 4 for i in range(100)}


def test_order_expressions(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0)], "i int, v double")
    assert {r["i"]: r["v"] for r in X.fill_null(df, "forward", order_by=F.desc("i"), columns=["v"]).collect()} == {1: 5.0, 2: 7.0, 3: 7.0}


@pytest.mark.parametrize("by", ["i", ["s", "i"], [], "desc"])
def test_fill_backward_reads_rows_once(spark, by):
    # frames up to the last row are read anew for every row
    by, sign = ([F.desc("i"), F.col("s")], -1) if by == "desc" else (by, 1)
    rows = [(None, "k", 3.0), (0, None, None), *ROWS[1:]]
    df = spark.createDataFrame(rows, "i int, s string, v double").coalesce(1)
    low = lambda x: (x is not None, x if x is not None else 0)
    if by and sign == 1:
        rows.sort(key=lambda r: (low(r[0]),) if by == "i" else ((r[1] is not None, r[1] or ""), low(r[0])))
    elif sign == -1:
        rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    want, last = {}, None
    for i, _, v in rows[::-1]:
        last = last if v is None else v
        want[i] = last
    out = X.fill_null(df, "backward", order_by=by, columns=["v"])
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert out.columns == df.columns and {r["i"]: r["v"] for r in out.collect()} == want


def test_running(spark):
    df = spark.createDataFrame([(f"v{i:04}", i % 5) for i in range(1000)], "k string, n long").repartition(5)
    total, want = 0, {}
    for i in range(1000):
        total += i % 5
        want[f"v{i:04}"] = total
    assert {r["k"]: r["t"] for r in bands.running(df, {"n": "t"}, "k").collect()} == want
    assert [r["v"] for r in stats.ranks(spark.createDataFrame([(3,), (1,), (3,), (None,)], "v int"), ["v"]).orderBy("v").collect()] == [None, 1.0, 2.5, 2.5]


@pytest.mark.parametrize("ext", ["csv", "json", "parquet", "orc", "feather"])
def test_chunks(spark, tmp_path, ext):
    path = str(tmp_path / f"x.{ext}")
    df = spark.range(0, 103, 1, 4).withColumn("t", F.concat(F.lit("row "), F.col("id").cast("string")))
    files.write(df, path)
    parts = [{r["id"] for r in files.read_partial(spark, path, chunks=c, n_chunks=5, columns=["id"]).collect()} for c in range(1, 6)]
    assert [len(p) for p in parts] == [20, 20, 20, 20, 23]
    assert set().union(*parts) == set(range(103))
    with pytest.raises(ValueError):
        files.read_partial(spark, path, chunks=[6], n_chunks=5)


def test_text_masks_skip_plain_rows(spark):
    draw, letters = random.Random(5), "ab @.12345678-/()\u0663\u0967\u4e2dx"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(40))) for _ in range(400)] + [None, "", "no data", "a@b.co", "ring 11 98888-7777", "10.0.0.1", "52998224725"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r for r in df.select("i", text.mask_text_column(F.col("t"), "hash", "s" * 40).alias("m"), text.spans(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["m"] == text.mask_text(t, "hash", "s" * 40)
        assert [x.asDict() for x in got[i]["s"]] == text.find_spans(t)


def test_ks(spark):
    a, b = [1.0, 2.0, 2.0, 3.0, None], [2.0, 3.0, 4.0, 4.0]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "v double")
    assert metrics.ks(frame(a), frame(b), "v").first()["ks"] == pytest.approx(0.5)
    assert metrics.ks(frame([]), frame([]), "v").first()["ks"] is None


def test_profile_and_inventory(spark, tmp_path):
    path = str(tmp_path / "x.parquet")
    spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "i int, s string").write.parquet(path)
    p = files.profile(spark, path, head=2)
    assert p["shape"] == (3, 2) and p["dtypes"] == {"i": "int", "s": "string"} and p["nulls"] == {"i": 0, "s": 1} and p["distinct"] == {"i": 2, "s": 3}
    assert len(p["head"]) == 2 and p["describe"][0]["column"] == "i" and "grade" in p["score"]
    assert json.dumps(p, default=str)
    (tmp_path / "bad.parquet").write_bytes(b"not parquet")
    rows = files.inventory(spark, str(tmp_path), extensions=[".parquet"]).where("file = 'bad.parquet'").collect()
    assert len(rows) == 1 and rows[0]["error"] and rows[0]["column"] is None
    with pytest.raises(Exception):
        files.inventory(spark, str(tmp_path), extensions=[".parquet"], skip_errors=False)


def test_safe_names():
    assert detect.is_safe("data_admissão") and detect.is_safe("criação") and not detect.is_safe("admiração")
