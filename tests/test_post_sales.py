"""post_sales against one-by-one posting (the source's semantics), in plain Python."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stockroom.operators import orders as O
from stockroom.operators.access import PERMISSIONS

from paths import SF_MID, SF_SMALL


def brute_force(requests, products, customers, user_store):
    """Post requests one by one in (requested_at, request_id) order."""
    stock = {(p["id"], p["store_id"]): p["quantity"] for p in products}
    names = {(p["id"], p["store_id"]): p["name"] for p in products}
    cust = {(c["id"], c["store_id"]) for c in customers}
    roles = {(m["user_id"], m["store_id"]): m["role"] for m in user_store}
    allowed = PERMISSIONS["create_sale"]
    out = {}
    for r in sorted(requests, key=lambda r: (r["requested_at"], r["request_id"])):
        rid, store = r["request_id"], r["store_id"]
        role = roles.get((r["user_id"], store))
        if role is None:
            out[rid] = "Access denied"
            continue
        if role not in allowed:
            out[rid] = "Insufficient permissions"
            continue
        if r["customer_id"] and (r["customer_id"], store) not in cust:
            out[rid] = "Invalid Customer"
            continue
        if r["items"] is None:
            out[rid] = "Items are required"
            continue
        work = dict(stock)
        reason = None
        for it in r["items"]:
            k = (it["product_id"], store)
            if k not in work:
                reason = f"Product with ID {it['product_id']} not found in store"
                break
            if it["quantity"] is None or it["quantity"] <= 0:
                reason = "Invalid quantity"
                break
            if work[k] is not None and work[k] < it["quantity"]:
                reason = f"Not enough stock for product {names[k]}"
                break
            if work[k] is not None:
                work[k] -= it["quantity"]
        if reason is None:
            stock = work
        out[rid] = reason
    return out


def run(t, requests):
    out = O.post_sales(requests, t, t.user_store)
    got = {r["request_id"]: r["reason"] for r in out.rejects.collect()}
    for r in out.keys.collect():
        got[r["request_id"]] = None
    return got, out


@pytest.mark.parametrize("sf_dir", [SF_SMALL, SF_MID])
def test_fixture_batch_equals_one_by_one(spark, sf_dir):
    from stockroom.sources.tables import from_testdata
    t = from_testdata(spark, sf_dir)
    req = O.nest_items(t.sale_request_headers, t.sale_request_lines, "request_id")
    got, out = run(t, req)
    want = brute_force([r.asDict(recursive=True) for r in req.collect()],
                       [r.asDict() for r in t.products.collect()],
                       [r.asDict() for r in t.customers.collect()],
                       [r.asDict() for r in t.user_store.collect()])
    assert got == want
    assert out.rounds >= 1


def _req(spark, rows):
    schema = ("request_id long, store_id long, user_id long, customer_id long, payment_method string, "
              "notes string, requested_at timestamp_ntz, "
              "items array<struct<product_id:long, quantity:int, unit_price:decimal(10,2)>>")
    return spark.createDataFrame(rows, schema)


def test_golden_cases(spark, t_small):
    """Hand-made cases from FIXTURES.md §3 on a tiny store."""
    products = spark.createDataFrame(
        [(1, 1, "apple", 5, Decimal("2.00")), (2, 1, "pear", 3, Decimal("1.50")),
         (3, 1, "plum", 1, Decimal("4.00")), (9, 2, "kiwi", 10, Decimal("1.00"))],
        "id long, store_id long, name string, quantity int, price decimal(10,2)")
    from stockroom.sources.schemas import evolve_schema
    customers = spark.createDataFrame([(100, 1, "c", "c@x.y"), (200, 2, "d", "d@x.y")],
                                      "id long, store_id long, name string, email string")
    user_store = spark.createDataFrame([(7, 1, "cashier"), (8, 1, "staff")],
                                       "user_id long, store_id long, role string")
    t = t_small.replace(products=evolve_schema(products, "products"), customers=customers,
                        user_store=user_store)
    d0 = dt.datetime(2024, 1, 1)

    def at(h):
        return d0 + dt.timedelta(hours=h)

    rows = [
        (1, 1, 7, 100, "cash", None, at(1), [(1, 5, None)]),           # exact stock: accepted, apple 0
        (2, 1, 7, None, "cash", None, at(2), [(1, 1, None)]),          # short: apple is 0
        (3, 1, 7, None, "cash", None, at(3), [(2, 2, None), (3, 2, None)]),  # 2nd line fails
        (4, 1, 7, None, "cash", None, at(4), [(2, 2, None), (2, 1, None)]),  # same product twice: 3 fits
        (5, 1, 7, None, "cash", None, at(5), [(3, 1, None), (2, 1, None)]),  # pear is 0 now: rejected
        (6, 1, 7, None, "cash", None, at(6), [(3, 1, None)]),          # plum still 1 (order 5 rolled back)
        (7, 1, 7, 200, "cash", None, at(7), [(3, 1, None)]),           # customer of another store
        (8, 1, 7, None, "cash", None, at(8), [(9, 1, None)]),          # product of another store
        (9, 1, 99, None, "cash", None, at(9), [(2, 1, None)]),         # no membership
        (10, 1, 8, None, "cash", None, at(10), [(2, 1, None)]),        # role staff
    ]
    got, out = run(t, _req(spark, rows))
    assert got == {
        1: None, 2: "Not enough stock for product apple", 3: "Not enough stock for product plum",
        4: None, 5: "Not enough stock for product pear", 6: None, 7: "Invalid Customer",
        8: "Product with ID 9 not found in store", 9: "Access denied", 10: "Insufficient permissions",
    }
    asked = {r["id"]: r["request_id"] for r in out.keys.collect()}
    lines = {(asked[r["sale_id"]], r["product_id"]): (r["quantity"], r["unit_price"]) for r in out.ledger.collect()}
    assert lines[(1, 1)] == (5, Decimal("2.00"))   # price from the product
    assert set(lines) == {(1, 1), (4, 2), (6, 3)}


def test_post_then_reverse_restores_stock(spark, t_small):
    from stockroom.operators.ledger import stock_on_hand, stock_ledger
    req = O.nest_items(t_small.sale_request_headers, t_small.sale_request_lines, "request_id")
    posted = O.post_sales(req, t_small, t_small.user_store)
    t2 = t_small.replace(sales=t_small.sales.unionByName(posted.rows),
                         sale_items=t_small.sale_items.unionByName(posted.ledger))
    rev = O.reverse_sales(posted.rows.select(F.col("id").alias("sale_id"), "store_id", "user_id"), t2)
    both = stock_ledger(posted.extra).unionByName(stock_ledger(rev.extra))
    after = stock_on_hand(t_small.products, both)
    assert after.filter("movement <> 0").count() == 0
    # never negative stock from a non-negative opening
    assert stock_on_hand(t_small.products, stock_ledger(posted.extra)).filter(
        "opening_quantity >= 0 AND quantity_on_hand < 0").count() == 0


def _one_store(spark, t_small, n_products, stock):
    from stockroom.sources.schemas import evolve_schema
    products = spark.range(1, n_products + 1).select(
        "id", F.lit(1).cast("long").alias("store_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"),
        F.lit(stock).cast("int").alias("quantity"), F.lit(Decimal("1.00")).alias("price"))
    return t_small.replace(products=evolve_schema(products, "products"),
                           customers=spark.createDataFrame([], "id long, store_id long, name string, email string"),
                           user_store=spark.createDataFrame([(7, 1, "cashier")], "user_id long, store_id long, role string"))


def _both(t, req):
    got, out = run(t, req)
    want = brute_force([r.asDict(recursive=True) for r in req.collect()], [r.asDict() for r in t.products.collect()],
                       [], [r.asDict() for r in t.user_store.collect()])
    assert got == want
    return out


def test_long_chain_takes_few_rounds(spark, t_small):
    """Every order shares a product with the next: one at a time, a round each; here the tail is bounded."""
    t = _one_store(spark, t_small, 301, 1)
    at = dt.datetime(2024, 1, 1)
    rows = [(i, 1, 7, None, "cash", None, at + dt.timedelta(minutes=i), [(i, 1, None), (i + 1, 1, None)])
            for i in range(1, 301)]
    assert _both(t, _req(spark, rows)).rounds <= O.SET_ROUNDS + 1


def test_hot_product_at_one_time_is_split(spark, t_small):
    """One product and one timestamp for all requests: its rows still lie in several buckets."""
    from stockroom.functions.prefix import BUCKET, bucketed
    t = _one_store(spark, t_small, 3, 40)
    at = dt.datetime(2024, 1, 1)
    rows = [(i, 1, 7, None, "cash", None, at, [(1, 1 + i % 3, None)]) for i in range(1, 201)]
    _both(t, _req(spark, rows))
    hot = spark.range(4000).select(F.col("id"), F.lit(1).alias("product_id"), F.lit(at).alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in bucketed(hot, ["product_id", "ts", "id"]).groupBy(BUCKET).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 1 and max(sizes) < 2000


def test_two_batches_have_distinct_ids(spark, t_small):
    """Two batches in a row, one order of them with 1,200 lines: every id and change id is given once."""
    t = _one_store(spark, t_small, 1200, 100)
    at = dt.datetime(2024, 1, 1)
    one = _req(spark, [(1, 1, 7, None, "cash", None, at, [(i, 1, None) for i in range(1, 1201)]),
                       (2, 1, 7, None, "cash", None, at, [(5, 1, None)])])
    a = O.post_sales(one, t, t.user_store)
    t2 = t.replace(sales=t.sales.unionByName(a.rows), sale_items=t.sale_items.unionByName(a.ledger),
                   products=O.next_products(t.products, a.extra, "2024-01-02 00:00:00"))
    b = O.post_sales(one, t2, t.user_store, last_change_id=1201)
    ids = [r["id"] for r in t2.sale_items.unionByName(b.ledger).select("id").collect()]
    assert len(ids) == len(set(ids)) and b.ledger.count() == 1201
    heads = [r["id"] for r in t2.sales.unionByName(b.rows).select("id").collect()]
    assert len(heads) == len(set(heads))
    changes = [r["change_id"] for r in a.extra.unionByName(b.extra).select("change_id").collect()]
    assert sorted(changes) == list(range(1, 2403))
    left = {r["id"]: r["quantity"] for r in O.next_products(t2.products, b.extra).collect()}
    assert left[1] == 98 and left[5] == 96
