"""List registered queries whose Spark and DuckDB column types differ."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import types as T

from oracle_compare import duck


def spark_type(t) -> str:
    if isinstance(t, T.DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    if isinstance(t, T.ArrayType):
        return spark_type(t.elementType) + "[]"
    if isinstance(t, T.StructType):
        return "STRUCT(" + ", ".join(f"{f.name} {spark_type(f.dataType)}" for f in t.fields) + ")"
    return {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.StringType: "VARCHAR", T.DoubleType: "DOUBLE",
            T.TimestampNTZType: "TIMESTAMP", T.DateType: "DATE", T.BooleanType: "BOOLEAN",
            T.TimestampType: "TIMESTAMP WITH TIME ZONE", T.ShortType: "SMALLINT",
            T.ByteType: "TINYINT", T.FloatType: "FLOAT"}.get(type(t), str(t))


def norm_duck(t: str) -> str:
    return t.replace('"', "")


def main(sf_dir):
    from stockroom.session import get_session
    spark = get_session("local[4]", 8)
    from __spark_entry__ import oracle_sql, queries
    q, o = queries(), oracle_sql()
    con = duck(sf_dir)
    skip = {"stream_stock_ledger", "stream_stock_on_hand", "load_tables", "append_ledger"}
    for name in sorted(o):
        if name in skip:
            continue
        df = q[name](spark, sf_dir)
        s = {f.name: spark_type(f.dataType) for f in df.schema.fields}
        rel = con.sql(o[name])
        d = {c: norm_duck(str(t)) for c, t in zip(rel.columns, rel.types)}
        diff = {c: (s.get(c), d.get(c)) for c in set(s) | set(d) if s.get(c) != d.get(c)}
        if diff:
            print(name, diff, flush=True)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001")
