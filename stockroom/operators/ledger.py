"""Ledgers: the trigger logic as set-based projections over change records.

Two ledgers, kept apart because the source's audit set cannot be summed to
stock (it logs full line quantities again on each header update):

* the **stock ledger** -- one signed movement per line change; summing it per
  product gives the stock change. Built in one pass over the change records
  (a ``when`` per (table, op)), no union of four scans.
* the **audit ledger** -- the log written by the audit triggers, including
  the header entries and the 'product must belong to the store' check whose
  failure aborts the change in the source (those changes come out as rejects).

``stock_on_hand`` = opening quantity + Σ signed movement, grouped by product
with map-side partial sums (a hot product is combined before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..sources.schemas import MONEY

LEDGER_COLS = ["change_id", "store_id", "product_id", "type", "quantity", "unit_price", "created_by",
               "reference_id", "notes", "created_at"]

# Ledger types and notes of the stock triggers, per line table
# and operation, with the sign applied to the line quantity.
#   (table, op): (type, notes, sign, image)
STOCK_RULES = {
    ("sale_items", "I"): ("sale", "Sale transaction", -1, "after"),
    ("purchase_items", "I"): ("purchase", "Purchase transaction", 1, "after"),
    ("sale_items", "D"): ("sale_reversal", "Sale reversal transaction", 1, "before"),
    ("purchase_items", "D"): ("purchase_reversal", "Purchase reversal transaction", -1, "before"),
}
# Our addition (the source moves stock for line updates in the handlers, not
# in a trigger): a line update moves stock by its quantity difference.
STOCK_UPDATE_RULES = {
    "sale_items": ("sale_adjustment", "Sale line quantity changed", -1),
    "purchase_items": ("purchase_adjustment", "Purchase line quantity changed", 1),
}

# Types and notes of the line audit triggers, per operation.
#   table: {op: (type, notes)}; quantity: created -new / updated old-new /
#   deleted +old for sales, and the opposite signs for purchases.
AUDIT_LINE_RULES = {
    "sale_items": {"I": ("sale_item_created", "Sale item created"),
                   "U": ("sale_item_updated", "Sale item updated"),
                   "D": ("sale_item_deleted", "Sale item deleted")},
    "purchase_items": {"I": ("purchase_item_created", "Purchase item created"),
                       "U": ("purchase_item_updated", "Purchase item updated"),
                       "D": ("purchase_item_deleted", "Purchase item deleted")},
}
ACTIONS = {"I": "created", "U": "updated", "D": "deleted"}


def _action(op: Column) -> Column:
    """'created' / 'updated' / 'deleted' for an operation code."""
    return _case([(op == code, F.lit(word)) for code, word in ACTIONS.items()])


def _case(pairs: list[tuple[Column, Column]]) -> Column:
    out = None
    for cond, val in pairs:
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out


def _ledger_select(df: DataFrame, **exprs: Column) -> DataFrame:
    cols = []
    for c in LEDGER_COLS:
        e = exprs[c]
        cast = {"quantity": "int", "unit_price": MONEY, "created_at": "timestamp_ntz", "type": "string",
                "notes": "string"}.get(c, "bigint")
        cols.append(e.cast(cast).alias(c))
    return df.select(*cols)


def drop_replays(changes: DataFrame) -> DataFrame:
    """One record per ``change_id``; records without one are all kept."""
    return (changes.filter(F.col("change_id").isNotNull()).dropDuplicates(["change_id"])
            .unionByName(changes.filter(F.col("change_id").isNull())))


# ---- stock ledger ------------------------------------------------------------

def stock_ledger(changes: DataFrame, types: list[str] | None = None, dedupe: bool = False) -> DataFrame:
    """Signed stock movements from line change records (one pass).

    ``types`` restricts to some ledger types (e.g. ``["sale"]``); ``dedupe``
    drops replayed records with the same ``change_id`` first (a shuffle by
    change_id -- use when the source may deliver a record twice). Records
    without a ``change_id`` can't be told from replays and are all kept.
    """
    if dedupe:
        changes = drop_replays(changes)
    tbl, op = F.col("table"), F.col("op")
    rules = []
    for (t, o), (typ, notes, sign, img) in STOCK_RULES.items():
        rules.append((t, o, typ, notes, F.col(f"{img}.quantity") * F.lit(sign), F.col(f"{img}.unit_price")))
    for t, (typ, notes, sign) in STOCK_UPDATE_RULES.items():
        rules.append((t, "U", typ, notes, (F.col("after.quantity") - F.col("before.quantity")) * F.lit(sign),
                      F.col("after.unit_price")))
    if types is not None:
        rules = [r for r in rules if r[2] in types]
    match = [((tbl == t) & (op == o)) for t, o, *_ in rules]
    out = changes.filter(_any(match))
    img = F.coalesce(F.col("after"), F.col("before"))
    return _ledger_select(
        out, change_id=F.col("change_id"), store_id=F.col("store_id"), product_id=img["product_id"],
        type=_case([(m, F.lit(r[2])) for m, r in zip(match, rules)]),
        quantity=_case([(m, r[4]) for m, r in zip(match, rules)]),
        unit_price=_case([(m, r[5]) for m, r in zip(match, rules)]),
        created_by=F.col("user_id"), reference_id=img["order_id"],
        notes=_case([(m, F.lit(r[3])) for m, r in zip(match, rules)]), created_at=F.col("ts"))


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def stock_on_hand(products: DataFrame, ledger: DataFrame) -> DataFrame:
    """Opening quantity + Σ signed movements, per product; products without movement kept.

    Movements for products that do not exist change nothing (as an UPDATE
    that matches no row).
    """
    mov = (ledger.filter(F.col("product_id").isNotNull()).groupBy("product_id")
           .agg(F.sum("quantity").cast("bigint").alias("movement")))
    p = products.select(F.col("id").alias("product_id"), "store_id", F.col("quantity").alias("opening_quantity"))
    return (p.join(mov, "product_id", "left")
            .select("product_id", "store_id", "opening_quantity",
                    F.coalesce("movement", F.lit(0).cast("bigint")).alias("movement"),
                    (F.col("opening_quantity").cast("bigint") + F.coalesce("movement", F.lit(0).cast("bigint")))
                    .alias("quantity_on_hand")))


def stock_reconciliation(stored: DataFrame, opening: DataFrame, ledger: DataFrame) -> DataFrame:
    """Stored quantity vs. opening + Σ ledger, per product, with the difference.

    Full outer join, so products present on one side only are reported too.
    ``status`` is 'ok', 'mismatch', 'missing_stored' or 'missing_expected'.
    """
    exp = stock_on_hand(opening, ledger).select("product_id", F.col("quantity_on_hand").alias("expected_quantity"))
    st = stored.select(F.col("id").alias("product_id"), F.col("quantity").cast("bigint").alias("stored_quantity"))
    j = st.join(exp, "product_id", "full_outer")
    status = (F.when(F.col("stored_quantity").isNull() & F.col("expected_quantity").isNotNull(), "missing_stored")
              .when(F.col("expected_quantity").isNull() & F.col("stored_quantity").isNotNull(), "missing_expected")
              .when(F.col("stored_quantity") == F.col("expected_quantity"), "ok")
              .when(F.col("stored_quantity").isNull(), "ok")
              .otherwise("mismatch"))
    return j.select("product_id", "stored_quantity", "expected_quantity",
                    (F.col("stored_quantity") - F.col("expected_quantity")).alias("difference"),
                    status.alias("status"))


# ---- audit ledger ------------------------------------------------------------

def _in_store(entries: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split entries by 'product exists in the entry's store' (the audit check)."""
    keys = products.select(F.col("id").alias("product_id"), "store_id")
    ok = entries.join(keys, ["product_id", "store_id"], "left_semi")
    bad = entries.join(keys, ["product_id", "store_id"], "left_anti")
    return ok, bad


def audit_line_entries(changes: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audit entries for line I/U/D changes, and the changes the check rejects.

    Returns ``(entries, rejects)``; a reject carries ``reason`` 'Product not found'.
    """
    tbl, op = F.col("table"), F.col("op")
    bq, aq = F.col("before.quantity"), F.col("after.quantity")
    sale = tbl == "sale_items"
    qty = (F.when(sale & (op == "I"), -aq).when(sale & (op == "U"), bq - aq).when(sale & (op == "D"), bq)
           .when(op == "I", aq).when(op == "U", aq - bq).when(op == "D", -bq))
    typ, notes = [], []
    for t, by_op in AUDIT_LINE_RULES.items():
        for o, (ty, no) in by_op.items():
            typ.append(((tbl == t) & (op == o), F.lit(ty)))
            notes.append(((tbl == t) & (op == o), F.lit(no)))
    img = F.coalesce(F.col("after"), F.col("before"))
    price = F.when(op == "D", F.col("before.unit_price")).otherwise(F.col("after.unit_price"))
    src = changes.filter(tbl.isin(*AUDIT_LINE_RULES) & op.isin("I", "U", "D"))
    entries = _ledger_select(src, change_id=F.col("change_id"), store_id=F.col("store_id"),
                             product_id=img["product_id"], type=_case(typ), quantity=qty, unit_price=price,
                             created_by=F.col("user_id"), reference_id=img["order_id"], notes=_case(notes),
                             created_at=F.col("ts"))
    ok, bad = _in_store(entries, products)
    return ok, bad.select("change_id", "store_id", "product_id", F.lit("Product not found").alias("reason"))


def audit_header_entries(header_changes: DataFrame, lines: DataFrame, products: DataFrame,
                         order_key: str, kind: str, suppliers: DataFrame | None = None
                         ) -> tuple[DataFrame, DataFrame]:
    """Audit entries for sale or purchase header changes, and rejects.

    One header entry ('{kind}_{action}', no product) per change, plus -- for
    updates only -- one entry per line of the order (sales: -qty, notes
    'Sale item'; purchases: +qty, notes 'Purchase item from {supplier}').
    Lines do not exist yet at insert time and are gone at delete time, so
    inserts and deletes log the header entry alone. If any line's product is
    not in the store, the whole header change is rejected (the source raises
    inside the trigger). Purchases need the supplier's name; a purchase whose
    supplier is unknown is rejected ('Purchase not found').
    """
    h = header_changes.filter(F.col("tbl") == ("sales" if kind == "sale" else "purchases"))
    action = _action(F.col("op"))
    h = h.withColumn("action", action)
    rejects = []
    if kind == "purchase":
        sup = suppliers.select(F.col("id").alias("party_id"), F.col("name").alias("supplier_name"))
        missing = h.join(sup, "party_id", "left_anti")
        rejects.append(missing.select("change_id", "store_id", F.lit(None).cast("bigint").alias("product_id"),
                                      F.lit("Purchase not found").alias("reason")))
        h = h.join(sup, "party_id")
        head_notes = F.concat(F.lit("Purchase from "), F.col("supplier_name"), F.lit(" "), F.col("action"))
        line_notes = F.concat(F.lit("Purchase item from "), F.col("supplier_name"))
        sign = 1
    else:
        head_notes = F.concat(F.lit("Sale "), F.col("action"))
        line_notes = F.lit("Sale item")
        sign = -1
    typ = F.concat(F.lit(kind + "_"), F.col("action"))
    # line entries of updates
    upd = h.filter(F.col("op") == "U")
    ln = lines.select(F.col(order_key).alias("header_id"), "product_id", "quantity", "unit_price")
    line_rows = upd.join(ln, "header_id")
    line_entries = _ledger_select(line_rows, change_id=F.col("change_id"), store_id=F.col("store_id"),
                                  product_id=F.col("product_id"), type=typ,
                                  quantity=F.col("quantity") * F.lit(sign), unit_price=F.col("unit_price"),
                                  created_by=F.col("user_id"), reference_id=F.col("header_id"),
                                  notes=line_notes, created_at=F.col("ts"))
    _, bad_lines = _in_store(line_entries, products)
    # found once and checkpointed: three branches below use it, and the update lines
    # behind it would be joined again for each
    bad_changes = cut(bad_lines.select("change_id").distinct())
    rejects.append(h.join(bad_changes, "change_id", "left_semi").select(
        "change_id", "store_id", F.lit(None).cast("bigint").alias("product_id"),
        F.lit("Product not found").alias("reason")))
    good = h.join(bad_changes, "change_id", "left_anti")
    head_entries = _ledger_select(good, change_id=F.col("change_id"), store_id=F.col("store_id"),
                                  product_id=F.lit(None), type=typ, quantity=F.lit(None),
                                  unit_price=F.lit(None), created_by=F.col("user_id"),
                                  reference_id=F.lit(None), notes=head_notes, created_at=F.col("ts"))
    entries = head_entries.unionByName(line_entries.join(bad_changes, "change_id", "left_anti"))
    rej = rejects[0]
    for r in rejects[1:]:
        rej = rej.unionByName(r)
    return entries, rej


def audit_suppliers(supplier_changes: DataFrame) -> DataFrame:
    """'Supplier {name} created|updated|deleted' per supplier change.

    The name comes from the change record's image (NEW for insert/update, OLD
    for delete), so a delete is logged instead of failing its lookup.
    """
    action = _action(F.col("op"))
    return _ledger_select(
        supplier_changes, change_id=F.col("change_id"), store_id=F.col("store_id"), product_id=F.lit(None),
        type=F.concat(F.lit("supplier_"), action), quantity=F.lit(None), unit_price=F.lit(None),
        created_by=F.col("user_id"), reference_id=F.lit(None),
        notes=F.concat(F.lit("Supplier "), F.col("name"), F.lit(" "), action), created_at=F.lit(None))


def quantity_change_entries(requests: DataFrame, products: DataFrame, as_of=None
                            ) -> tuple[DataFrame, DataFrame]:
    """Ledger entries for direct product quantity changes; unknown product -> reject.

    The note defaults to 'Product {name} quantity changed by {n}'.
    """
    p = products.select(F.col("id").alias("product_id"), "store_id", F.col("name").alias("product_name"))
    ok = requests.join(p, ["product_id", "store_id"])
    bad = requests.join(p, ["product_id", "store_id"], "left_anti")
    note = F.coalesce(F.col("notes"), F.concat(F.lit("Product "), F.col("product_name"),
                                               F.lit(" quantity changed by "), F.col("quantity").cast("string")))
    ts = F.lit(None) if as_of is None else F.lit(str(as_of)).cast("timestamp_ntz")
    entries = _ledger_select(ok, change_id=F.lit(None), store_id=F.col("store_id"),
                             product_id=F.col("product_id"), type=F.col("type"), quantity=F.col("quantity"),
                             unit_price=F.col("unit_price"), created_by=F.col("user_id"),
                             reference_id=F.col("reference_id"), notes=note, created_at=ts)
    return entries, bad.select("store_id", "product_id", F.lit("Product not found").alias("reason"))
