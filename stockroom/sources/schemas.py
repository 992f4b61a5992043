"""Canonical table schemas and schema evolution.

Types follow the source SQL: keys widened to long, money DECIMAL(10,2),
quantities INTEGER. Timestamps are naive wall-clock values
(``timestamp_ntz``), the type the source parquet files carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, I, S = T.LongType(), T.IntegerType(), T.StringType()
MONEY = T.DecimalType(10, 2)
TS = T.TimestampNTZType()


def _st(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "store": _st(("id", L), ("name", S), ("location", S), ("owner_name", S), ("user_id", L),
                 ("logo_url", S), ("updated_at", TS)),
    "users": _st(("user_id", L), ("name", S), ("email", S)),
    "user_store": _st(("user_id", L), ("store_id", L), ("role", S)),
    "categories": _st(("id", L), ("store_id", L), ("name", S), ("description", S), ("created_at", TS)),
    "products": _st(("id", L), ("store_id", L), ("category_id", L), ("name", S), ("description", S),
                    ("sku", S), ("barcode", S), ("unit", S), ("image_url", S), ("status", S),
                    ("price", MONEY), ("quantity", I), ("min_stock_level", I), ("max_stock_level", I),
                    ("updated_at", TS), ("last_updated_at", TS)),
    "customers": _st(("id", L), ("store_id", L), ("name", S), ("email", S)),
    "suppliers": _st(("id", L), ("store_id", L), ("name", S), ("contact_info", S), ("email", S),
                     ("phone", S), ("address", S), ("created_at", TS), ("updated_at", TS)),
    "sales": _st(("id", L), ("store_id", L), ("customer_id", L), ("user_id", L), ("payment_method", S),
                 ("payment_status", S), ("discount", MONEY), ("tax", MONEY), ("notes", S),
                 ("created_at", TS), ("updated_at", TS), ("last_updated_at", TS)),
    "sale_items": _st(("id", L), ("sale_id", L), ("product_id", L), ("quantity", I), ("unit_price", MONEY)),
    "purchases": _st(("id", L), ("store_id", L), ("supplier_id", L), ("user_id", L), ("notes", S),
                     ("created_at", TS), ("updated_at", TS), ("last_updated_at", TS)),
    "purchase_items": _st(("id", L), ("purchase_id", L), ("product_id", L), ("quantity", I),
                          ("unit_price", MONEY)),
    "product_reviews": _st(("id", L), ("product_id", L), ("user_id", L), ("rating", I), ("review_text", S),
                           ("created_at", TS), ("updated_at", TS)),
    "inventory_transactions": _st(("store_id", L), ("product_id", L), ("type", S), ("quantity", I),
                                  ("unit_price", MONEY), ("created_by", L), ("reference_id", L),
                                  ("notes", S), ("created_at", TS)),
}

# Stored totals of orders: one row per sale or purchase. ``known``: its header has been seen.
TOTALS = _st(("id", L), ("store_id", L), ("total_amount", T.DecimalType(38, 2)), ("total_items", L),
             ("known", T.BooleanType()))

# Column defaults added by the schema updates of the source
# (ADD COLUMN ... DEFAULT ...). Columns not listed default to NULL.
DEFAULTS: dict[str, dict[str, object]] = {
    "products": {"status": "active"},
    "sales": {"payment_status": "pending", "discount": 0, "tax": 0},
}


def stored_schema(table: str, absent: list[str] | None = None) -> T.StructType:
    """The schema to read a stored table with, without the columns ``absent``.

    A column that was added with a default carries it as its existence default:
    a file written before the column was there gives the default, a file that has
    the column gives what was written, NULL included. So files of all ages can lie
    in one folder.
    """
    fields = []
    for f in SCHEMAS[table].fields:
        if f.name in (absent or []):
            continue
        default = DEFAULTS.get(table, {}).get(f.name)
        if default is not None:
            literal = f"'{default}'" if isinstance(default, str) else f"CAST({default} AS {f.dataType.simpleString()})"
            f = T.StructField(f.name, f.dataType, True, {"EXISTS_DEFAULT": literal})
        fields.append(f)
    return T.StructType(fields)


def evolve_schema(df: DataFrame, table: str) -> DataFrame:
    """Conform ``df`` to the canonical schema of ``table``.

    Columns the frame lacks are added with their declared default (or NULL),
    typed; present columns are cast to the canonical type; column order is the
    canonical order. Extra columns are dropped. Pure projection: no shuffle.
    """
    schema = SCHEMAS[table]
    defaults = DEFAULTS.get(table, {})
    have = set(df.columns)
    cols: list[Column] = []
    for f in schema.fields:
        if f.name in have:
            c = F.col(f.name).cast(f.dataType)
            # a declared existence default belongs to the files, not to what is made of them
            cols.append(c.alias(f.name, metadata={}) if df.schema[f.name].metadata else c.alias(f.name))
        else:
            cols.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
    return df.select(*cols)


# Request batch schemas (JSON bodies with an ``items`` array).
ITEM = T.StructType([T.StructField("product_id", L), T.StructField("quantity", I),
                     T.StructField("unit_price", MONEY)])
SALE_REQUEST = _st(("request_id", L), ("store_id", L), ("user_id", L), ("customer_id", L),
                   ("payment_method", S), ("notes", S), ("requested_at", TS),
                   ("items", T.ArrayType(ITEM)))
PURCHASE_REQUEST = _st(("request_id", L), ("store_id", L), ("user_id", L), ("supplier_id", L),
                       ("notes", S), ("requested_at", TS), ("items", T.ArrayType(ITEM)))
