"""Ingest S1-S5: CSV with the dashboard's headers, missing-value text, bad input."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from shelfwise.operators.metrics import enrich
from shelfwise.schema import InventorySchemaError, validate_schema
from shelfwise.sources.dates import DateFormatError
from shelfwise.sources.guard import STRUCTURE, guarded_inventory
from shelfwise.sources.inventory import load_enriched, read_inventory, save_enriched
from shelfwise.sources.stored import read_stored, stored_table

HEADER = ("Date,Store ID,Product ID,Category,Inventory Level,Units Sold,Units Ordered,"
          "Demand Forecast,Price,Vendor,Vendor Avg Delivery Days\n")


def _csv(lines):
    d = tempfile.mkdtemp(prefix="shelfwise-csv-")
    p = os.path.join(d, "inventory.csv")
    with open(p, "w") as fh:
        fh.write(HEADER + "".join(line + "\n" for line in lines))
    return p


def test_csv_round_trip(spark):
    p = _csv(["2024-01-01,S001,P0001,Groceries,231,127,55,135.47,33.5,Acme,3",
              "2024-01-02,S001,P0001,Groceries,NA,NaN,,n/a,33.5,NULL,3"])
    df = read_inventory(spark, p)
    rows = df.orderBy("row_seq").collect()
    assert rows[0].inventory_level == 231.0 and rows[0].obs_date.isoformat() == "2024-01-01"
    assert rows[0].vendor == "Acme" and rows[0].product_id == "P0001"
    assert rows[1].inventory_level is None and rows[1].units_sold is None
    assert rows[1].units_ordered is None and rows[1].demand_forecast is None
    assert rows[1].vendor is None
    assert dict(df.dtypes)["price"] == "double"
    e = enrich(df).orderBy("row_seq").collect()
    assert e[0].days_to_stockout == 2.0 and e[1].stockout_risk == 0


def test_malformed_date_fails_the_load(spark):
    p = _csv(["2024-13-45,S001,P1,Toys,1,1,1,1,1,V,1"])
    with pytest.raises(Exception):
        read_inventory(spark, p).collect()
    lenient = read_inventory(spark, p, strict=False).first()
    assert lenient.obs_date is None


def test_malformed_number_fails_the_load(spark):
    p = _csv(["2024-01-01,S001,P1,Toys,lots,1,1,1,1,V,1"])
    with pytest.raises(Exception):
        read_inventory(spark, p).collect()


def test_missing_column_is_named(spark):
    df = spark.createDataFrame([(1,)], "obs_date int")
    with pytest.raises(InventorySchemaError, match="lacks columns"):
        validate_schema(df)


def test_save_and_reload_enriched(spark):
    p = _csv(["2024-01-01,S001,P1,Toys,10,2,1,1,1,V,1",
              "2024-01-05,S002,P2,Toys,20,2,1,1,1,V,1"])
    df = enrich(read_inventory(spark, p))
    out = os.path.join(tempfile.mkdtemp(prefix="shelfwise-store-"), "t")
    save_enriched(df, out, files=2)
    back = load_enriched(spark, out)
    assert back.count() == 2
    assert back.where(F.col("obs_date") == "2024-01-05").count() == 1


def test_csv_ingest_of_whole_table_matches_parquet_path(spark):
    """The sf0.001 inventory written as the dashboard's CSV reads back to the same reports."""
    from conftest import sf_dir
    from shelfwise.operators.overview import stock_health
    from shelfwise.operators.procurement import urgency_counts
    from shelfwise.schema import CSV_HEADERS
    from shelfwise.sources.star import star_schema_inventory

    inv = star_schema_inventory(spark, sf_dir("0.001"))
    back = {v: k for k, v in CSV_HEADERS.items()}
    out = os.path.join(tempfile.mkdtemp(prefix="shelfwise-csv-"), "inv")
    # The dashboard's headers, plus the row sequence as its own column.
    (inv.select(*[F.col(c).cast("string").alias(back.get(c, c)) for c in inv.columns])
        .write.option("header", True).csv(out))
    df = read_inventory(spark, out)
    assert dict(df.dtypes)["row_seq"] == "bigint"
    assert df.count() == inv.count()
    assert stock_health(enrich(df)).first() == stock_health(enrich(inv)).first()
    assert sorted(urgency_counts(enrich(df)).collect()) == sorted(urgency_counts(enrich(inv)).collect())


def _files(texts):
    d = tempfile.mkdtemp(prefix="shelfwise-csv-")
    for name, text in texts.items():
        with open(os.path.join(d, name), "w") as fh:
            fh.write(text)
    return d


def test_headers_in_different_order(spark):
    cols = HEADER.strip().split(",")
    row = dict(zip(cols, "2024-01-01,S1,P1,Toys,10,2,3,4,5,V,6".split(",")))
    other = [*cols[:4], "Units Sold", "Inventory Level", *cols[6:]]
    d = _files({"1.csv": HEADER + ",".join(row[c] for c in cols) + "\n",
                "2.csv": ",".join(other) + "\n" + ",".join(row[c] for c in other) + "\n"})
    with pytest.raises(Exception):
        read_inventory(spark, d).collect()
    both = read_inventory(spark, [os.path.join(d, "1.csv"), os.path.join(d, "2.csv")]).collect()
    assert [(r.inventory_level, r.units_sold) for r in both] == [(10.0, 2.0), (10.0, 2.0)]


def test_row_numbers_follow_files_and_lines(spark):
    line = "2024-01-01,S1,{0},Toys,10,2,3,4,5,V,6\n"
    d = _files({"1.csv": HEADER + "".join(line.format(f"a{k:04d}") for k in range(10)),
                "2.csv": HEADER + "".join(line.format(f"b{k:04d}") for k in range(3000))})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("8k", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for path in (d, [os.path.join(d, "1.csv"), os.path.join(d, "2.csv")]):
                ids = [r.product_id for r in read_inventory(spark, path).orderBy("row_seq").collect()]
                assert ids == sorted(ids) and len(ids) == 3010
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


REST = ",S1,P1,Toys,1,1,1,1,1,V,1"


def _dates(spark, texts, **how):
    lines = [('"%s"' % t if "," in t else t) + REST for t in texts]
    return [r.obs_date.isoformat() for r in read_inventory(spark, _csv(lines), **how).orderBy("row_seq").collect()]


def test_one_date_format_is_elected(spark):
    for texts in (["2024/01/02", "2024/1/31"], ["20240102", "20240131"], ["Jan 2, 2024", "Jan 31, 2024"],
                  ["02/01/2024", "31/01/2024"], ["01/02/2024", "1/31/2024"], ["2024-01-02T10:00:00", "2024-01-31 9:00"],
                  ["01/02/2024 10:30", "01/31/2024"], ["2 January 2024", "31 January 2024"], ["2-Jan-2024", "31-Jan-2024"],
                  ["02.01.2024", "31.01.2024"], ["01-02-2024", "01-31-2024"]):
        assert _dates(spark, texts) == ["2024-01-02", "2024-01-31"], texts
    assert _dates(spark, ["1/1/2024", "NA", "3/3/2024"][::2]) == ["2024-01-01", "2024-03-03"]  # day or month first: the same
    assert _dates(spark, ["02/01/2024"], date_format="dd/MM/yyyy") == ["2024-01-02"]
    with pytest.raises(Exception):
        _dates(spark, ["2024-01-02"], date_format="dd.MM.yyyy")


def test_mixed_and_ambiguous_dates_are_refused(spark):
    with pytest.raises(DateFormatError, match="fits 2 and not the other 1, such as '01/02/2024'"):
        _dates(spark, ["2024-01-02", "2024-01-03", "01/02/2024"])
    with pytest.raises(DateFormatError, match="differ on 1 of them"):
        _dates(spark, ["01/02/2024", "03/03/2024"])
    lenient = read_inventory(spark, _csv([d + REST for d in ("2024-01-02", "2024-01-03", "01/02/2024")]), strict=False)
    assert [r.obs_date and r.obs_date.isoformat() for r in lenient.orderBy("row_seq").collect()] == \
        ["2024-01-02", "2024-01-03", None]


def test_quoted_fields_load_as_pandas_loads_them(spark):
    import pandas as pd
    vendors = ['Smith "The, Best" Co', "Two\nlines", '"', "a,b", ' "x" ', "plain"]
    lines = ['2024-01-02,S1,P%d,Toys,1,1,1,1,1,"%s",%d' % (k, v.replace('"', '""'), k) for k, v in enumerate(vendors)]
    p = _csv(lines)
    got = read_inventory(spark, p, multiline=True).orderBy("row_seq").collect()
    frame = pd.read_csv(p)
    assert [r.vendor for r in got] == vendors == list(frame["Vendor"])
    assert [r.vendor_avg_delivery_days for r in got] == list(frame["Vendor Avg Delivery Days"])
    single = read_inventory(spark, _csv([x for x in lines if "Two" not in x])).orderBy("row_seq").collect()
    assert [r.vendor for r in single] == [v for v in vendors if "Two" not in v]


def test_file_order_with_line_breaks_in_fields(spark):
    line = '2024-01-01,S1,{0},Toys,10,2,3,4,5,"V\nW",6\n'
    d = _files({f"{name}.csv": HEADER + "".join(line.format(f"{name}{k:04d}") for k in range(n))
                for name, n in (("1", 10), ("2", 700), ("3", 5))})
    ids = [r.product_id for r in read_inventory(spark, d, multiline=True).orderBy("row_seq").collect()]
    assert ids == sorted(ids) and len(ids) == 715


def test_parquet_without_row_numbers_is_filtered_at_the_scan(spark):
    rest = read_inventory(spark, _csv([f"2024-01-{1 + k // 40:02d},S1,{k:04d},Toys,{k},1,1,1,1,V,1" for k in range(900)]))
    out = os.path.join(tempfile.mkdtemp(prefix="shelfwise pq %20-"), "t")
    rest.repartitionByRange(3, "product_id").sortWithinPartitions("product_id").drop("row_seq").write.parquet(out)
    for path in (out, [os.path.join(out, f) for f in sorted(os.listdir(out)) if f.endswith("parquet")][:1]):
        df = read_inventory(spark, path, fmt="parquet")
        ids = [r.product_id for r in df.orderBy("row_seq").collect()]
        assert ids == sorted(ids) and len(ids) > 250
        few = df.where("obs_date = DATE'2024-01-03'")
        assert "EqualTo(obs_date,2024-01-03)" in few._jdf.queryExecution().executedPlan().toString()
        assert {r.obs_date.day for r in few.collect()} <= {3}


def test_guard_puts_bad_rows_aside_and_counts_them(spark):
    ok = "2024-01-02,S1,P1,Toys,1,1,1,1,1,V,1"
    p = _csv([ok, "soon,S1,P2,Toys,lots,1,1,1,1,V,1", "2024-01-02,S1,P3,Toys,NA,,nan,1,1,,1", "2024-01-02,S1,P4",
              ok + ",9", "2024-01-05,S1,P5,Toys,1,1,1,1,1e400x,V,1", '2024-01-05,S1,P6,Toys,1,1,1,1,1,"a ""b"", c",1'])
    found = guarded_inventory(spark, p, os.path.join(tempfile.mkdtemp(prefix="shelfwise-guard-"), "t"))
    assert found.counts == {"rows": 7, "accepted": 3, "wrong number of fields": 2, "obs_date: not a date": 1,
                            "inventory_level: not a number": 1, "price: not a number": 1}
    assert [(r.product_id, r.vendor) for r in found.accepted.orderBy("row_seq").collect()] == \
        [("P1", "V"), ("P3", None), ("P6", 'a "b", c')]
    bad = found.rejected.orderBy("row_seq").collect()
    assert [r.problems for r in bad] == [["obs_date: not a date", "inventory_level: not a number"], [STRUCTURE], [STRUCTURE],
                                         ["price: not a number"]]
    assert [r.row_seq for r in bad] == [1, 3, 4, 5] and '"Inventory Level":"lots"' in bad[0].record
    assert '"line":"2024-01-02,S1,P4"' in bad[1].record
    assert enrich(found.accepted).count() == 3
    with pytest.raises(InventorySchemaError, match="4 of 7 rows are bad: wrong number of fields \\(2\\)"):
        found.check()
    assert found.check(most=0.6) is found


def test_guard_of_a_sound_and_of_an_incomplete_file(spark):
    d = tempfile.mkdtemp(prefix="shelfwise-guard-")
    found = guarded_inventory(spark, _csv(["2024-01-02,S1,P1,Toys,1,1,1,1,1,V,1"]), os.path.join(d, "a"))
    assert found.counts == {"rows": 1, "accepted": 1} and found.rejected.count() == 0 and found.check().accepted.count() == 1
    folder = _files({"1.csv": "Date,Store ID\n2024-01-02,S1\n"})
    with pytest.raises(InventorySchemaError, match="lacks columns"):
        guarded_inventory(spark, folder, os.path.join(d, "b"))


def test_a_stored_table_follows_its_source(spark):
    d = tempfile.mkdtemp(prefix="shelfwise-stored-")
    source, built = os.path.join(d, "source"), []

    def report():
        def build():
            built.append(1)
            return spark.read.parquet(source).groupBy().agg(F.sum("id").alias("total"))
        return read_stored(spark, os.path.join(d, "store"), source, build).first().total

    spark.range(10).write.parquet(source)
    assert report() == report() == 45 and len(built) == 1
    spark.range(11).write.mode("overwrite").parquet(source)
    assert report() == 55 and len(built) == 2
    spark.range(100, 101).write.mode("append").parquet(source)
    assert report() == 155 and report() == 155 and len(built) == 3
    now = stored_table(spark, os.path.join(d, "store"), source, lambda path: None)
    os.remove(os.path.join(now, "_SUCCESS"))  # a build that was cut short
    assert report() == 155 and len(built) == 4


def test_reports_follow_the_tables(spark):
    """A rewritten folder of tables changes the reports of the same session."""
    import shutil

    from conftest import sf_dir
    from shelfwise.plans.catalog import QUERIES, SOURCES
    d = tempfile.mkdtemp(prefix="shelfwise-tables-")
    for t in SOURCES:
        shutil.copy(os.path.join(sf_dir("0.001"), f"{t}.parquet"), d)
    before = QUERIES["h1_stock_health"](spark, d).first().total_rows
    half = spark.read.parquet(os.path.join(d, "lineitem.parquet")).where("l_orderkey % 2 = 0")
    kept = half.count()
    half.coalesce(1).write.parquet(os.path.join(d, "half"))
    part = next(f for f in os.listdir(os.path.join(d, "half")) if f.endswith(".parquet"))
    shutil.copy(os.path.join(d, "half", part), os.path.join(d, "lineitem.parquet"))
    assert before == 6000 and QUERIES["h1_stock_health"](spark, d).first().total_rows == kept < 6000


def test_missing_text_is_exact_and_only_in_csv(spark):
    p = _csv(["2024-01-01, NA ,P1,NA,1,1,1,1,1,None,1", "2024-01-01,  ,P1,Toys,1,1,1,1,1,V,1"])
    a, b = read_inventory(spark, p).orderBy("row_seq").collect()
    assert (a.store_id, a.category, a.vendor, b.store_id) == (" NA ", None, None, "  ")
    out = os.path.join(tempfile.mkdtemp(prefix="shelfwise-pq-"), "t")
    df = read_inventory(spark, p).withColumn("vendor", F.lit("NA")).withColumn("price", F.lit(float("nan")))
    df.write.parquet(out)
    rows = read_inventory(spark, out, fmt="parquet").collect()
    assert [r.vendor for r in rows] == ["NA", "NA"] and [r.price for r in rows] == [None, None]
