"""Sources and sinks: schema evolution, JSON output, ledger append round trip."""

import json

from pyspark.sql import functions as F

from stockroom.session import scratch_dir
from stockroom.sources.schemas import SCHEMAS, evolve_schema
from stockroom.sources.sinks import append_ledger, export_json, read_ledger, to_json_documents


def test_evolve_schema_adds_defaults_and_types(spark):
    old = spark.createDataFrame([(1, "9.5", "extra")], "id int, discount string, junk string")
    new = evolve_schema(old, "sales")
    assert [(f.name, f.dataType) for f in new.schema] == [(f.name, f.dataType) for f in SCHEMAS["sales"]]
    r = new.collect()[0]
    assert r["id"] == 1 and str(r["discount"]) == "9.50" and r["payment_status"] == "pending"
    assert str(r["tax"]) == "0.00" and r["notes"] is None
    assert evolve_schema(spark.createDataFrame([(1,)], "id long"), "products").collect()[0]["status"] == "active"


def test_json_keeps_null_fields_and_nesting(spark):
    df = spark.createDataFrame([(1, None, [(1, "a")])], "id long, notes string, items array<struct<k:int, v:string>>")
    doc = json.loads(to_json_documents(df).collect()[0]["json"])
    assert doc == {"id": 1, "notes": None, "items": [{"k": 1, "v": "a"}]}
    path = scratch_dir(spark, "test-json")
    export_json(df, path)
    line = json.loads(spark.read.text(path).collect()[0]["value"])
    assert line["notes"] is None and line["items"] == [{"k": 1, "v": "a"}]


def test_ledger_append_round_trip(spark):
    cols = [f.name for f in SCHEMAS["inventory_transactions"].fields]
    row = spark.createDataFrame([(3, None, "supplier_created", None, None, 7, None, "Supplier X created", None, None)],
                                "store_id long, product_id long, type string, quantity int, "
                                "unit_price decimal(10,2), created_by long, reference_id long, notes string, "
                                "created_at timestamp_ntz, change_id long")
    path = scratch_dir(spark, "test-ledger")
    append_ledger(row, path)
    append_ledger(row.withColumn("store_id", F.lit(4).cast("bigint")), path)
    back = read_ledger(spark, path)
    assert dict(back.dtypes)["store_id"] == "bigint"
    assert sorted(r["store_id"] for r in back.collect()) == [3, 4]
    assert set(cols) <= set(back.columns)
