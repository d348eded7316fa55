import json

import pytest
from pyspark.sql import functions as F

from stallwright.sources import files, html


def test_column_names():
    assert files.column_name(" Unit Fulfillment Fee (Drop Shipping) ") == "unit_fulfillment_fee_drop_shipping"
    assert files.column_name("Seller-SKU（ＪＰ）") == "seller-sku_ｊｐ"


def test_read_delimited(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿Name,Qty (pcs),Note\n" a ",1,"x, ""y""\nz"\n,,\nb,2\n', encoding="utf-8")
    rows = [tuple(r) for r in files.read_delimited(spark, str(p)).collect()]
    assert rows == [("a", "1", 'x, "y"\nz'), ("b", "2", "")]
    t = tmp_path / "b.tsv"
    t.write_text("a\tb\tc\n1\t2\t3\n")
    assert files.sniff_delimiter(spark, str(t)) == "\t"


def test_read_json_array_and_rejects(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps([{"sku": "s1", "price": 10, "stock": 3}, {"price": -1, "stock": 1}]))
    df = files.read_json_array(spark, str(p), "sku string, price double, stock int")
    got = [r.errors for r in files.reject_rows(df, ["sku"], ["price"], ["stock"]).orderBy(F.desc("price")).collect()]
    assert got == ["", "missing sku; bad number price"]
    p.write_text('{"a": 1}')
    with pytest.raises(Exception, match="not a JSON array"):
        files.read_json_array(spark, str(p), "a int").collect()


def test_land_raw_numbers_rows(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("k"))
    rows = files.land_raw(df, "run", ["k"]).orderBy("row_index").collect()
    assert [r.row_index for r in rows] == list(range(1, 101))
    assert [json.loads(r.raw)["k"] for r in rows] == list(range(100))
    assert all(len(r.row_hash) == 16 for r in rows)


def test_product_cards(spark):
    page = '<div class="c"><a href="/1">A</a><b>10</b></div><div class="c">PR<a href="/2">B</a></div><div class="c"><a href="/3">C</a></div>'
    df = spark.createDataFrame([(1, page), (2, None)], "k int, html string")
    got = html.product_cards(df, "k", "html", '(?s)<div class="c">.*?</div>', {"url": 'href="([^"]*)"', "price": "<b>([0-9]+)</b>"}, "PR", 10)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(1, 1, "/1", "10"), (1, 2, "/3", None)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_land_raw_keeps_every_row_of_a_large_input(spark, adaptive):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 1_000_000
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"))
        rows = files.land_raw(df, "run", ["k"]).select("row_index", F.get_json_object("raw", "$.k").cast("long").alias("k"))
        got = rows.agg(F.count("*"), F.count_distinct("row_index"), F.min("row_index"), F.max("row_index"), F.sum((F.col("row_index") != F.col("k") + 1).cast("int"))).first()
        assert tuple(got) == (n, n, 1, n, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_reports_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    files.write_report(df, str(tmp_path / "r"), df.agg(F.count("*").alias("n")))
    files.write_report(df, str(tmp_path / "r"), df.agg(F.count("*").alias("n")))
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "r/rows")).select("k", "v").collect())) == [(1, "a"), (2, None)]
    assert spark.read.json(str(tmp_path / "r/summary")).first().n == 2
