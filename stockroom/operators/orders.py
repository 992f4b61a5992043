"""Batch write paths for orders: post, update and reverse sales and purchases.

Requests are JSON-like rows with an ``items`` array (product_id, quantity,
unit_price); lines are ``posexplode``d so the line order is kept. Each
operator returns an :class:`~stockroom.operators.catalog.Outcome`. Stock
movements come out as change records (``extra``), so the stock and audit
ledgers of :mod:`stockroom.operators.ledger` apply to them unchanged.

``post_sales`` is the one order-dependent operator: the source posts orders
one by one, every line must find enough stock, and a rejected order leaves
its stock to later ones. It is solved exactly, set-based, in rounds (see
:func:`post_sales`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.components import components
from ..functions.ids import largest, number_rows, number_within
from ..functions.lineage import cut, cut_and_count, keep
from ..functions.prefix import BUCKET, bucketed, sum_before
from ..sources.changes import LINE_CHANGE
from ..sources.schemas import MONEY, evolve_schema
from ..sources.tables import Tables
from .access import authorize_requests
from .catalog import Outcome, _ts

INVALID_CUSTOMER = "Invalid Customer"
INVALID_SUPPLIER = "Invalid Supplier"


def not_found_msg(pid: Column) -> Column:
    return F.concat(F.lit("Product with ID "), pid.cast("string"), F.lit(" not found in store"))


def short_msg(name: Column) -> Column:
    return F.concat(F.lit("Not enough stock for product "), name)


# nest_items: so many lines at most in one array of a posted request.
PART_LINES = 1_000


def nest_items(headers: DataFrame, lines: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Request rows with ``items`` = their lines in ``line_no`` order (NULL if none).

    With ``most``, a request of more lines comes in several rows of at most so many; ``first_pos`` is the place
    of a row's first line in its request. The posting operators read these; no task holds a request whole.
    """
    if most is not None:
        return _nest_in_parts(headers, lines, key, most)
    item = F.struct("line_no", "product_id", "quantity", "unit_price")
    per = lines.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    items = F.transform("_items", lambda x: F.struct(x["product_id"].alias("product_id"),
                                                      x["quantity"].alias("quantity"),
                                                      x["unit_price"].alias("unit_price")))
    return headers.join(per, key, "left").withColumn("items", items).drop("_items")


def _nest_in_parts(headers: DataFrame, lines: DataFrame, key: str, most: int) -> DataFrame:
    """:func:`nest_items` with at most ``most`` lines in a row; nothing is dealt by the request alone.

    Lines come in blocks of ``most`` line numbers, and a block's first place is the count of the lines before it. Only
    where that gives a block of more lines, or far more rows than needed, a request's lines are numbered first.
    """
    order = ["line_no", "product_id", "quantity", "unit_price"]
    lines = keep(lines.filter(F.col(key).isNotNull())
                 .select(key, F.expr(f"(line_no - 1) div {most}").alias("_block"), *order), "request-lines")
    of, before = Window.partitionBy(key), Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    fits = ((F.max("_n").over(of) <= most) & (F.count("_block").over(of) == F.count(F.lit(1)).over(of))
            & (F.count(F.lit(1)).over(of) <= 2 * F.ceil(F.sum("_n").over(of) / most)))
    blocks = keep(lines.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
                  .select(key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("first_pos"),
                          fits.alias("_fits")), "request-blocks")
    parts = blocks.filter("_fits").select(key, "_block", "first_pos")
    nested = F.array_sort(F.collect_list(F.struct(*order))).alias("_items")
    if blocks.filter("NOT _fits").isEmpty():
        per = lines.groupBy(key, "_block").agg(nested)
    else:
        same = (lines[key] == blocks[key]) & lines["_block"].eqNullSafe(blocks["_block"])
        dealt = lines.join(blocks, same).select(lines["*"], "_fits")
        numbered = keep(number_within(dealt.filter("NOT _fits").select(key, *order), key, order, "_pos")
                        .withColumn("_block", F.expr(f"_pos div {most}")), "numbered-lines")
        per = (dealt.filter("_fits").groupBy(key, "_block").agg(nested)
               .unionByName(numbered.groupBy(key, "_block").agg(nested)))
        parts = parts.unionByName(numbered.groupBy(key, "_block").agg(F.min("_pos").alias("first_pos")))
    return (headers.join(parts, key, "left").join(per, [key, "_block"], "left")
            .select(key, *[c for c in headers.columns if c != key],
                    F.transform("_items", lambda x: F.struct(*[x[c].alias(c) for c in order[1:]])).alias("items"),
                    F.coalesce("first_pos", F.lit(0)).cast("bigint").alias("first_pos")))


def _rows_of(requests: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """The rows of the requests in ``heads``; a long request's are matched one by one."""
    asked = requests.select(key, "first_pos").join(heads.select(key), key, "left_semi")
    return requests.join(asked, [key, "first_pos"], "left_semi")


def _posted(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of posted requests, written once, and those of them that stand for a request: its first ones."""
    if "first_pos" not in requests.columns:
        requests = requests.withColumn("first_pos", F.lit(0).cast("bigint"))
    requests = keep(requests, "requests")
    return requests, requests.filter("first_pos = 0").withColumn("_no_items", F.col("items").isNull()).drop("items", "first_pos")


def _lines(req: DataFrame, key: str, extra: list[str]) -> DataFrame:
    pos = F.col("first_pos") + F.col("pos") if "first_pos" in req.columns else F.col("pos")
    first = ["first_pos"] if "first_pos" in req.columns else []
    return req.select(key, *extra, *first, F.posexplode("items").alias("pos", "item")).select(
        key, *extra, pos.cast("int").alias("pos"), F.col("item.product_id").alias("product_id"),
        F.col("item.quantity").alias("quantity"), F.col("item.unit_price").alias("unit_price"))


# post_sales: after so many set-based rounds every other one decides the open
# requests one by one, independent parts side by side, so many lines of a part at a time.
SET_ROUNDS = 4
GROUP_ROWS = 100_000

SEVERAL = "Several requests for one order in a batch"


def single_requests(requests: DataFrame, key: str, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requests whose ``key`` is unique among ``requests``, and rejects for the rest.

    The source applies requests one at a time; a batch carries no order among
    several requests for one order, so all of them are rejected (with the
    reason) rather than one chosen arbitrarily. Only requests that pass every
    other check may be given here: a request that is denied anyway stands in
    no other's way. Counted with a partial aggregate and joined back -- no
    window over a hot key.
    """
    n = requests.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    r = requests.join(n, key)
    return (r.filter("_n = 1").drop("_n"),
            r.filter("_n > 1").select(*cols, F.lit(SEVERAL).alias("reason")))


def _truthy(c: Column) -> Column:
    """A JavaScript-truthy id: given and not 0."""
    return c.isNotNull() & (c != 0)


def _change_records(df: DataFrame, table: str, op: str | None, before: Column | None, after: Column | None) -> DataFrame:
    """Change records of ``df``; without an ``op`` each row has its own, and its number ``_n`` goes along."""
    img = LINE_CHANGE["before"].dataType
    return df.select(*([] if op else ["_n"]), F.lit(table).alias("table"),
                     (F.lit(op) if op else F.col("op")).alias("op"),
                     (before if before is not None else F.lit(None)).cast(img).alias("before"),
                     (after if after is not None else F.lit(None)).cast(img).alias("after"),
                     F.col("store_id").cast("bigint"), F.col("user_id").cast("bigint"),
                     F.col("ts").cast("timestamp_ntz"))


def _image(id_: str, order: str, product: str, qty: str, price: str) -> Column:
    return F.struct(F.col(id_).alias("id"), F.col(order).alias("order_id"), F.col(product).alias("product_id"),
                    F.col(qty).cast("int").alias("quantity"), F.col(price).cast(MONEY).alias("unit_price"))


def number_changes(records: DataFrame, last_change_id: int) -> DataFrame:
    """Change records with a ``change_id`` of their own, above the last one given so far, in no order."""
    numbered = number_rows(records, None, "change_id", last_change_id)
    return numbered.select("change_id", "table", "op", "before", "after", "store_id", "user_id", "ts")


# ---- post_sales ---------------------------------------------------------------------

def post_sales(requests: DataFrame, t: Tables, user_store: DataFrame | None = None,
               as_of=None, last_change_id: int = 0) -> Outcome:
    """Create sales exactly as if posted one by one in (requested_at, request_id) order.

    Per order, in the handler's order: access ('Access denied' /
    'Insufficient permissions'), customer in the store ('Invalid Customer'),
    then per line: product in the store, stock >= quantity (earlier lines of
    the same order already took theirs). Any failure rejects the whole order,
    and a rejected order takes no stock. Prices come from the product.

    Set-based form. Order-independent rejects first (access, customer, product
    not in store, quantity <= 0 -- the last is our check). Then, per product
    in request order, every round computes two exclusive running sums of the
    demand of earlier requests: ``hi`` over requests not rejected, ``lo``
    over requests already accepted. A request whose every product has
    ``stock - hi >= demand`` is accepted; one with a product where
    ``stock - lo < demand`` is rejected; the rest stay open. The earliest open
    request sees only decided requests before it, so each round decides at
    least one request and the loop ends; the verdicts equal one-by-one
    posting (for positive quantities, an order's lines of one product pass
    in turn iff their sum fits). Orders that wait for one another in a long
    chain would cost a round each, so from SET_ROUNDS rounds on every other one
    goes through the parts that wait for one another, each by itself
    (:func:`_post_by_component`). The driver only counts open requests per
    round; the state is checkpointed each round
    (:func:`~stockroom.functions.lineage.cut`) to cut the lineage.

    Returns ``rows`` = new sales, ``extra`` = line change records ('I' per
    new line), ``ledger`` = new sale lines, ``rejects`` = (request_id, reason),
    ``keys`` = (request_id, id of the new sale). New sales and lines get ids
    above the tables' largest, in posting and line order; change records get
    theirs above ``last_change_id``.
    """
    key = "request_id"
    requests, heads = _posted(requests)
    heads, several = single_requests(heads, key, [key])
    heads = heads.select(key, "store_id", "user_id", "customer_id", "payment_method", "notes", "requested_at", "_no_items")
    requests = _rows_of(requests, heads, key)
    # -- header checks
    if user_store is not None:
        auth = authorize_requests(heads.select(key, "user_id", "store_id"), user_store, "create_sale")
        heads = heads.join(auth.select(key, F.col("reason").alias("_access")), key, "left")
    cust = t.customers.select(F.col("id").alias("customer_id"), "store_id").withColumn("_cust", F.lit(True))
    heads = heads.join(cust, ["customer_id", "store_id"], "left")
    head_reason = F.when(F.col("_access").isNotNull(), F.col("_access")) if user_store is not None else None
    cust_bad = _truthy(F.col("customer_id")) & F.col("_cust").isNull()
    head_reason = (head_reason.when(cust_bad, F.lit(INVALID_CUSTOMER)) if head_reason is not None
                   else F.when(cust_bad, F.lit(INVALID_CUSTOMER)))
    head_reason = head_reason.when(F.col("_no_items"), F.lit("Items are required"))
    heads = keep(heads.withColumn("head_reason", head_reason).drop("_cust"), "heads")

    # -- lines with their product
    prod = t.products.select(F.col("id").alias("product_id"), "store_id", F.col("quantity").alias("stock"),
                             "price", F.col("name").alias("product_name"))
    lines = (_lines(requests, key, ["store_id", "requested_at"])
             .join(prod.withColumn("_found", F.lit(True)), ["product_id", "store_id"], "left"))
    static_bad = F.col("_found").isNull() | F.col("quantity").isNull() | (F.col("quantity") <= 0)
    lines = bucketed(lines.withColumn("_static_bad", static_bad), ["product_id", "requested_at", key, "pos"])

    bad_req = lines.filter("_static_bad").select(key).distinct()
    state0 = (heads.join(bad_req.withColumn("_lb", F.lit(True)), key, "left")
              .select(key, F.when(F.col("head_reason").isNotNull() | F.col("_lb"), F.lit("rejected"))
                      .otherwise(F.lit("open")).alias("status")))

    # -- demand per (request, product) of requests still in play
    demand = (lines.filter(~F.col("_static_bad"))
              .groupBy(key, "product_id", "requested_at")
              # an order's lines of a product may lie in two buckets: the first of them keeps the order
              .agg(F.sum("quantity").cast("bigint").alias("q"), F.min(BUCKET).alias(BUCKET))
              .join(prod.select("product_id", "stock"), "product_id"))
    demand = demand.join(state0.filter("status = 'open'"), key, "left_semi").persist()

    # requests in play with no demand (an empty item list) need no stock
    has_demand = demand.select(key).distinct().withColumn("_d", F.lit(True))
    state, n_open = cut_and_count(
        state0.join(has_demand, key, "left")
        .select(key, F.when((F.col("status") == "open") & F.col("_d").isNull(), "accepted")
                .otherwise(F.col("status")).alias("status")), "status = 'open'")
    rounds = 0
    while n_open > 0:  # ends: each round decides at least the earliest open request
        rounds += 1
        if rounds > SET_ROUNDS and (rounds - SET_ROUNDS) % 2 == 1:
            state, n_open = cut_and_count(_post_by_component(demand, state, key), "status = 'open'")
            continue
        d = demand.join(state, key)
        if rounds > 1:
            # only products with an open request can change a verdict: later
            # rounds touch just the contended products, not the whole demand
            # (in round 1 nearly every product is open, so the filter would
            # cost two shuffles for nothing)
            open_products = d.filter("status = 'open'").select("product_id").distinct()
            d = d.join(open_products, "product_id", "left_semi")
        d = d.select("*", F.when(F.col("status") != "rejected", F.col("q")).otherwise(F.lit(0)).alias("hi"),
                     F.when(F.col("status") == "accepted", F.col("q")).otherwise(F.lit(0)).alias("lo"))
        d = sum_before(d, "product_id", "requested_at", [key], ["hi", "lo"])
        sure_pass = F.col("stock").isNull() | (F.col("stock") - F.col("hi_before") >= F.col("q"))
        sure_fail = F.col("stock").isNotNull() & (F.col("stock") - F.col("lo_before") < F.col("q"))
        verdict = (d.filter("status = 'open'").groupBy(key)
                   .agg(F.max(sure_fail.cast("int")).alias("_f"), F.min(sure_pass.cast("int")).alias("_p")))
        new = F.when(F.col("_f") == 1, "rejected").when(F.col("_p") == 1, "accepted")
        nxt = (state.join(verdict, key, "left")
               .select(key, F.when(F.col("status") == "open", F.coalesce(new, F.lit("open")))
                       .otherwise(F.col("status")).alias("status")))
        # each round's state is checkpointed (a plan leaf in the shared folder);
        # the same job counts the requests still open
        state, n_open = cut_and_count(nxt, "status = 'open'")
    demand.unpersist()

    # -- reasons of rejected requests: first failing line at the stock the order saw
    st = state.join(heads.select(key, "head_reason"), key)
    acc = state.filter("status = 'accepted'").select(key).withColumn("_acc", F.lit(True))
    # only products of rejected orders matter here: accepted lines need no running sum
    asked = lines.join(state.filter("status = 'rejected'").select(key), key, "left_semi").select("product_id").distinct()
    ln = lines.join(asked, "product_id", "left_semi").join(acc, key, "left").withColumn(
        "take", F.when(F.col("_acc") & ~F.col("_static_bad"), F.col("quantity")).otherwise(F.lit(0)))
    ln = ln.withColumn("_order", F.col("pos"))
    ln = sum_before(ln, "product_id", "requested_at", [key, "_order"], ["take"])
    own = Window.partitionBy(key, "product_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ln = ln.withColumn("own_before", F.coalesce(F.sum(F.when(F.col("quantity") > 0, F.col("quantity"))).over(own),
                                                F.lit(0)))
    line_reason = (F.when(F.col("_found").isNull(), not_found_msg(F.col("product_id")))
                   .when(F.col("quantity").isNull() | (F.col("quantity") <= 0), F.lit("Invalid quantity"))
                   .when(F.col("stock").isNotNull()
                         & (F.col("stock") - F.col("take_before") - F.col("own_before") < F.col("quantity")),
                         short_msg(F.col("product_name"))))
    first_bad = (ln.filter(F.col("_acc").isNull()).withColumn("lr", line_reason).filter(F.col("lr").isNotNull())
                 .groupBy(key).agg(F.min(F.struct("pos", "lr")).alias("_m"))
                 .select(key, F.col("_m.lr").alias("line_reason")))
    rejected = (st.filter("status = 'rejected'").join(first_bad, key, "left")
                .select(key, F.coalesce("head_reason", "line_reason", F.lit("Rejected")).alias("reason"))
                .unionByName(several))

    # -- accepted output
    acc_heads = _numbered(heads.join(acc, key, "left_semi"), lines, largest(t.sales))
    # the customer id is stored as given (0 only skips the customer check)
    sales = evolve_schema(acc_heads.select("id", "store_id", "customer_id",
                                           "user_id", "payment_method", "notes",
                                           F.col("requested_at").alias("created_at"),
                                           _ts(as_of).alias("updated_at")), "sales")
    new_lines = lines.select(key, "pos", "product_id", F.col("quantity").cast("int").alias("quantity"),
                             F.col("price").alias("unit_price"))
    new_lines, changes = _new_lines(new_lines, acc_heads, "sale", largest(t.sale_items), last_change_id)
    out = Outcome(sales, rejected, ledger=new_lines, extra=changes, keys=acc_heads.select(key, "id"))
    out.rounds = rounds
    return out


def _post_by_component(demand: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """``state`` with open requests decided one by one, those that share no contended product side by side.

    A product is contended if an open line of it may fail; only through such
    products does a request wait for another, so the components of that
    graph are independent. Each gives its first GROUP_ROWS lines in posting
    order, in whole requests; the earliest open requests need no later one. What
    they see of the stock, the opening less the accepted orders before them,
    comes from the running sums; a task only adds what it accepts itself. It
    holds whole components of 2 * GROUP_ROWS lines, and one order, at most.
    """
    d = demand.filter(F.col("stock").isNotNull()).join(state.filter("status <> 'rejected'"), key)
    d = d.join(d.filter("status = 'open'").select("product_id").distinct(), "product_id", "left_semi")
    d = d.withColumn("lo", F.when(F.col("status") == "accepted", F.col("q")).otherwise(F.lit(0)))
    d = sum_before(d.withColumn("hi", F.col("q")), "product_id", "requested_at", [key], ["hi", "lo"])
    d = d.filter("status = 'open'")
    contended = d.filter("stock - hi_before < q").select("product_id").distinct()
    rows = cut(d.join(contended, "product_id", "left_semi")
               .select(key, "requested_at", "product_id", (F.col("stock") - F.col("lo_before")).alias("left"), "q"))
    if rows.count() <= GROUP_ROWS:  # one group, whatever the components
        grouped = rows.withColumn("_group", F.lit(0).cast("bigint"))
    else:
        grouped = rows.join(_groups(rows, key), key)

    def decide(group):
        import pandas as pd

        group = group.sort_values(["requested_at", key], na_position="first", kind="stable")
        taken: dict[int, int] = {}
        out = []
        for request, lines in group.groupby(key, sort=False):
            lines = list(zip(lines["product_id"], lines["left"], lines["q"]))
            ok = all(left - taken.get(p, 0) >= q for p, left, q in lines)
            if ok:
                for p, _, q in lines:
                    taken[p] = taken.get(p, 0) + q
            out.append((request, "accepted" if ok else "rejected"))
        return pd.DataFrame(out, columns=[key, "verdict"])

    verdict = grouped.groupBy("_group").applyInPandas(decide, f"{key} long, verdict string")
    return (state.join(verdict, key, "left")
            .select(key, F.coalesce("verdict", "status").alias("status")))


def _groups(rows: DataFrame, key: str) -> DataFrame:
    """(key, ``_group``) of the first GROUP_ROWS lines of each component of ``rows`` in posting order."""
    requests = rows.groupBy(key, "requested_at").agg(F.min("product_id").alias("a"), F.count(F.lit(1)).alias("_lines"))
    links = rows.join(requests.select(key, "a"), key).select("a", F.col("product_id").alias("b"))
    part = components(links).withColumnRenamed("node", "a")
    requests = (requests.join(part, "a", "left")
                .select(key, "requested_at", "_lines", F.coalesce("component", "a").alias("component")))
    placed = number_rows(requests, ["component", "requested_at", key], "_n", weight="_lines")
    start = placed.groupBy("component").agg(F.min("_lines_before").alias("_start"))
    return (placed.join(start, "component").filter(F.col("_lines_before") - F.col("_start") < GROUP_ROWS)
            .select(key, F.expr(f"_start div {GROUP_ROWS}").alias("_group")))


def _numbered(heads: DataFrame, lines: DataFrame, last_id: int) -> DataFrame:
    """Accepted headers with their ``id`` in posting order, and ``_lines_before``, the lines of those before them."""
    n = lines.groupBy("request_id").agg(F.count(F.lit(1)).alias("_lines"))
    heads = heads.join(n, "request_id", "left").fillna(0, ["_lines"])
    return number_rows(heads, ["requested_at", "request_id"], "id", last_id, weight="_lines")


def _new_lines(lines: DataFrame, heads: DataFrame, kind: str, last_id: int, last_change_id: int
               ) -> tuple[DataFrame, DataFrame]:
    """Lines (request_id, pos, ...) of the new orders ``heads``, numbered in order, and their 'I' change records.

    A line's number is that of its order's first line plus its place there, so
    the lines need no order of their own. Its change record has the same number,
    counted from ``last_change_id``. A header meets its lines in parts, so that
    those of a long order lie in several tasks.
    """
    heads = heads.select("request_id", F.col("id").alias(f"{kind}_id"), "store_id", "user_id",
                         F.col("requested_at").alias("ts"), "_lines_before",
                         F.explode(F.expr(f"sequence(0L, greatest(_lines - 1, 0) div {PART_LINES})")).alias("_part"))
    rows = (lines.withColumn("_part", F.expr(f"pos div {PART_LINES}")).join(heads, ["request_id", "_part"]).drop("_part")
            .withColumn("_n", F.col("_lines_before") + F.col("pos") + 1))
    rows = rows.withColumn("id", (F.col("_n") + F.lit(last_id)).cast("bigint"))
    records = _change_records(rows, f"{kind}_items", "I", None,
                              _image("id", f"{kind}_id", "product_id", "quantity", "unit_price"))
    ids = (F.col("after.id") - F.lit(last_id) + F.lit(last_change_id)).cast("bigint")
    return (evolve_schema(rows, f"{kind}_items"),
            records.select(ids.alias("change_id"), *records.columns))


# ---- post_purchases -------------------------------------------------------------------

def post_purchases(requests: DataFrame, t: Tables, user_store: DataFrame | None = None, as_of=None,
                   last_change_id: int = 0) -> Outcome:
    """Create purchases: supplier in the store, every line's product in the store.

    No stock condition, so this is pure joins: the first failing line (in line
    order) gives the reason. Prices come from the request; stock rises. Ids
    are given as in :func:`post_sales`, in (requested_at, request_id) order.
    """
    key = "request_id"
    requests, heads = _posted(requests)
    heads, several = single_requests(heads, key, [key])
    heads = heads.select(key, "store_id", "user_id", "supplier_id", "notes", "requested_at", "_no_items")
    requests = _rows_of(requests, heads, key)
    if user_store is not None:
        auth = authorize_requests(heads.select(key, "user_id", "store_id"), user_store, "create_purchase")
        heads = heads.join(auth.select(key, F.col("reason").alias("_access")), key, "left")
    sup = t.suppliers.select(F.col("id").alias("supplier_id"), "store_id").withColumn("_sup", F.lit(True))
    heads = heads.join(sup, ["supplier_id", "store_id"], "left")
    prod = t.products.select(F.col("id").alias("product_id"), "store_id").withColumn("_found", F.lit(True))
    lines = keep(_lines(requests, key, ["store_id"]).join(prod, ["product_id", "store_id"], "left"), "lines")
    first_bad = (lines.filter(F.col("_found").isNull())
                 .groupBy(key).agg(F.min(F.struct("pos", "product_id")).alias("_m"))
                 .select(key, not_found_msg(F.col("_m.product_id")).alias("line_reason")))
    heads = heads.join(first_bad, key, "left")
    reason = None
    if user_store is not None:
        reason = F.when(F.col("_access").isNotNull(), F.col("_access"))
    for cond, msg in [(F.col("_sup").isNull(), F.lit(INVALID_SUPPLIER)),
                      (F.col("_no_items"), F.lit("Items are required")),
                      (F.col("line_reason").isNotNull(), F.col("line_reason"))]:
        reason = F.when(cond, msg) if reason is None else reason.when(cond, msg)
    heads = keep(heads.withColumn("reason", reason), "heads")
    ok = _numbered(heads.filter(F.col("reason").isNull()), lines, largest(t.purchases))
    rejects = heads.filter(F.col("reason").isNotNull()).select(key, "reason").unionByName(several)
    purchases = evolve_schema(ok.select("id", "store_id", "supplier_id", "user_id", "notes",
                                        F.col("requested_at").alias("created_at"),
                                        _ts(as_of).alias("updated_at")), "purchases")
    new_lines, changes = _new_lines(lines.select(key, "pos", "product_id", "quantity", "unit_price"), ok, "purchase",
                                    largest(t.purchase_items), last_change_id)
    return Outcome(purchases, rejects, ledger=new_lines, extra=changes, keys=ok.select(key, "id"))


# ---- updates ----------------------------------------------------------------------------

def _apply_updates(requests: DataFrame, t: Tables, kind: str, user_store: DataFrame | None, as_of,
                   last_change_id: int = 0) -> Outcome:
    """Header COALESCE patch + line diff by product, for sales or purchases.

    Matched product (the lowest current line id of that product): new
    quantity; the price is kept for sales and replaced for purchases. New
    product: a line at the request price. Current lines whose product is not
    in the new list: deleted. No stock condition. A request naming one
    product twice is rejected (the source applies such lines in turn against
    the old quantity, which no order-free rule reproduces). Of the requests
    that pass all these checks, several for one order are rejected. New lines
    get ids above the table's largest, in (order, line) order.
    """
    sale = kind == "sale"
    key, heads_t, lines_t = (("sale_id", t.sales, t.sale_items) if sale
                             else ("purchase_id", t.purchases, t.purchase_items))
    party, party_t, party_msg = (("customer_id", t.customers, INVALID_CUSTOMER) if sale
                                 else ("supplier_id", t.suppliers, INVALID_SUPPLIER))
    action = "update_sale" if sale else "update_purchase"
    req = requests
    reason = None
    if user_store is not None:
        req = (authorize_requests(req, user_store, action).drop("action", "role", "allowed")
               .withColumnRenamed("reason", "_access"))
        reason = F.when(F.col("_access").isNotNull(), F.col("_access"))
    pt = party_t.select(F.col("id").alias(party), "store_id").withColumn("_party", F.lit(True))
    req = req.join(pt, [party, "store_id"], "left")
    cur = heads_t.select(F.col("id").alias(key), "store_id").withColumn("_head", F.lit(True))
    req = req.join(cur, [key, "store_id"], "left")
    # a request's own lines: nothing is counted across requests
    named = F.transform("items", lambda x: x["product_id"])
    req = req.withColumn("_dup", F.size(F.array_distinct(named)) < F.size(named))
    for cond, msg in [(_truthy(F.col(party)) & F.col("_party").isNull(), party_msg),
                      (F.col("_head").isNull(), "Sale not found" if sale else "Purchase not found"),
                      (F.col("_dup"), "Duplicate product in items")]:
        reason = F.when(cond, F.lit(msg)) if reason is None else reason.when(cond, F.lit(msg))
    req = keep(req.withColumn("reason", reason), "updates")
    ok, several = single_requests(req.filter(F.col("reason").isNull()), key, [key, "store_id"])
    rejects = req.filter(F.col("reason").isNotNull()).select(key, "store_id", "reason").unionByName(several)

    # header patch
    h = heads_t.join(ok.select(F.col(key).alias("id"), F.col(party).alias("_np"),
                               *([F.col("payment_method").alias("_npm")] if sale else []),
                               F.col("notes").alias("_nn")), "id")
    patched = h.select(*[
        (F.coalesce("_np", party).alias(party) if c == party else
         F.coalesce("_npm", "payment_method").alias(c) if (sale and c == "payment_method") else
         F.coalesce("_nn", "notes").alias(c) if c == "notes" else
         _ts(as_of).alias(c) if c == "updated_at" else F.col(c))
        for c in heads_t.columns])
    patched = evolve_schema(patched, "sales" if sale else "purchases")

    # line diff for requests with items: one full outer join of the old and the new lines by order and product. The
    # accepted batch is checkpointed once, so both sides share it instead of re-deriving it.
    with_items = cut(ok.filter(F.col("items").isNotNull())
                     .select(key, "store_id", "user_id", F.col("requested_at").alias("ts"), "items"))
    head = ["store_id", "user_id", "ts"]
    new = _lines(with_items, key, head)
    new = new.select(key, "product_id", "pos", F.col("quantity").alias("new_q"), F.col("unit_price").alias("new_p"), *head)
    old = lines_t.join(with_items.drop("items"), key).select(
        key, "product_id", F.col("id").alias("old_id"), F.col("quantity").alias("old_q"), F.col("unit_price").alias("old_p"),
        *[F.col(c).alias(f"old_{c}") for c in head])
    m = old.join(new, [key, "product_id"], "full_outer")
    m = m.select(key, "product_id", "pos", "old_id", "old_q", "old_p", "new_q", "new_p",
                 *[F.coalesce(c, f"old_{c}").alias(c) for c in head])
    # of several old lines of a product the lowest is the one that is matched; the join's partitions already hold them
    first = F.min("old_id").over(Window.partitionBy(key, "product_id"))
    op = (F.when(F.col("old_id").isNull(), "I").when(F.col("pos").isNull(), "D")
          .when(F.col("old_id") == F.col("_first"), "U"))
    m = m.withColumn("_first", first).withColumn("op", op).drop("_first")
    # one numbering for both: inserted lines come first, so their numbers give their ids too
    last = largest(lines_t)
    m = cut(m)
    done = number_rows(m.filter(F.col("op").isNotNull()), [F.col("op") != "I", F.col(key), F.col("pos"), F.col("old_id")], "_n")
    done = done.withColumn("id", F.when(F.col("op") == "I", F.col("_n") + F.lit(last)).otherwise(F.col("old_id")).cast("bigint"))
    tbl = "sale_items" if sale else "purchase_items"
    keep_p = F.when(F.col("op") == "U", F.col("old_p" if sale else "new_p")).otherwise(F.col("new_p"))
    done = done.withColumn("keep_p", keep_p)
    records = _change_records(done, tbl, None, F.when(F.col("op") != "I", _image("id", key, "product_id", "old_q", "old_p")),
                              F.when(F.col("op") != "D", _image("id", key, "product_id", "new_q", "keep_p")))
    changes = records.select((F.col("_n") + F.lit(last_change_id)).cast("bigint").alias("change_id"), *records.columns[1:])
    # final lines of the updated orders: untouched duplicates, updated, inserted
    final_lines = evolve_schema(
        m.filter(F.col("op").isNull()).select(F.col("old_id").alias("id"), key, "product_id", F.col("old_q").alias("quantity"),
                                              F.col("old_p").alias("unit_price"))
        .unionByName(done.filter("op <> 'D'").select("id", key, "product_id", F.col("new_q").cast("int").alias("quantity"),
                                                     F.col("keep_p").alias("unit_price"))),
        tbl)
    return Outcome(patched, rejects, ledger=final_lines, extra=changes)


def apply_sale_updates(requests: DataFrame, t: Tables, user_store: DataFrame | None = None, as_of=None,
                       last_change_id: int = 0) -> Outcome:
    return _apply_updates(requests, t, "sale", user_store, as_of, last_change_id)


def apply_purchase_updates(requests: DataFrame, t: Tables, user_store: DataFrame | None = None,
                           as_of=None, last_change_id: int = 0) -> Outcome:
    return _apply_updates(requests, t, "purchase", user_store, as_of, last_change_id)


# ---- reversals ----------------------------------------------------------------------------

def _reverse(requests: DataFrame, t: Tables, kind: str, user_store: DataFrame | None, as_of,
             last_change_id: int = 0) -> Outcome:
    """Delete orders and their lines; stock returns (sales) or leaves (purchases).

    An unknown (id, store) rejects with no effect (the source rolls back). Of
    several valid requests for one order the one with the least user id
    deletes it; the others find no order. ``rows`` = remaining headers,
    ``ledger`` = remaining lines, ``extra`` = 'D' change records of the
    deleted lines, ``keys`` = ids of the deleted orders.
    """
    sale = kind == "sale"
    key, heads_t, lines_t = (("sale_id", t.sales, t.sale_items) if sale
                             else ("purchase_id", t.purchases, t.purchase_items))
    req = requests.select(key, "store_id", "user_id")
    reason = None
    if user_store is not None:
        req = (authorize_requests(req, user_store, "delete_sale" if sale else "delete_purchase")
               .drop("action", "role", "allowed").withColumnRenamed("reason", "_access"))
        reason = F.when(F.col("_access").isNotNull(), F.col("_access"))
    cur = heads_t.select(F.col("id").alias(key), "store_id").withColumn("_head", F.lit(True))
    req = req.join(cur, [key, "store_id"], "left")
    msg = "Sale not found" if sale else "Purchase not found"
    reason = F.when(F.col("_head").isNull(), F.lit(msg)) if reason is None else reason.when(
        F.col("_head").isNull(), F.lit(msg))
    req = keep(req.withColumn("reason", reason), "reversals")
    valid = req.filter(F.col("reason").isNull())
    ok = (valid.groupBy(key, "store_id").agg(F.min("user_id").alias("user_id"), F.count(F.lit(1)).alias("_n")))
    late = (ok.filter("_n > 1").withColumn("_k", F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("_n"))))
            .select(key, "store_id", F.lit(msg).alias("reason")))
    ok = ok.drop("_n")
    rejects = req.filter(F.col("reason").isNotNull()).select(key, "store_id", "reason").unionByName(late)
    remaining_heads = heads_t.join(ok.select(F.col(key).alias("id")), "id", "left_anti")
    gone_lines = lines_t.join(ok.select(key), key, "left_semi")
    remaining_lines = lines_t.join(ok.select(key), key, "left_anti")
    ch = gone_lines.join(ok.withColumn("ts", _ts(as_of)), key)
    changes = _change_records(ch, "sale_items" if sale else "purchase_items", "D",
                              _image("id", key, "product_id", "quantity", "unit_price"), None)
    return Outcome(remaining_heads, rejects, ledger=remaining_lines, extra=number_changes(changes, last_change_id),
                   keys=ok.select(F.col(key).alias("id")))


def reverse_sales(requests: DataFrame, t: Tables, user_store: DataFrame | None = None, as_of=None,
                  last_change_id: int = 0) -> Outcome:
    return _reverse(requests, t, "sale", user_store, as_of, last_change_id)


def reverse_purchases(requests: DataFrame, t: Tables, user_store: DataFrame | None = None,
                      as_of=None, last_change_id: int = 0) -> Outcome:
    return _reverse(requests, t, "purchase", user_store, as_of, last_change_id)


def next_products(products: DataFrame, changes: DataFrame, as_of=None) -> DataFrame:
    """The ``products`` table after a batch's line change records.

    Every product with a movement gets its new quantity and ``updated_at``; a
    NULL quantity stays NULL. Partial sums per product, then one join.
    """
    d = stock_delta(changes).filter(F.col("product_id").isNotNull()).withColumnRenamed("product_id", "id")
    j = products.join(d, "id", "left")
    moved = F.col("delta").isNotNull()
    return j.select(*[
        (F.col("quantity") + F.coalesce("delta", F.lit(0))).cast("int").alias(c) if c == "quantity" else
        F.when(moved, _ts(as_of)).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c)
        for c in products.columns])


def stock_delta(changes: DataFrame) -> DataFrame:
    """Net stock change per product implied by line change records."""
    from .ledger import stock_ledger
    return (stock_ledger(changes).groupBy("product_id")
            .agg(F.sum("quantity").cast("bigint").alias("delta")))


def batch_changes(out: Outcome, t: Tables, kind: str, as_of=None) -> dict:
    """What a posted, updated or reversed batch does to the stored tables, for
    :func:`~stockroom.sources.snapshots.apply_batch`: products that moved, orders and lines that are new, changed or gone.

    ``keys`` of a reversal are the ids of the deleted orders; of any other batch ``rows`` and ``ledger`` are new versions.
    """
    from ..sources.snapshots import Change
    heads, lines = f"{kind}s", f"{kind}_items"
    moved = t.products.join(out.extra.select(F.coalesce("after.product_id", "before.product_id").alias("id")).distinct(),
                            "id", "left_semi")
    gone = out.extra.filter("op = 'D'").select(F.col("before.id").alias("id"))
    deleted = out.keys is not None and out.keys.columns == ["id"]
    return {"products": Change(next_products(moved, out.extra, as_of).select(*t.products.columns)),
            heads: Change(out.rows.limit(0) if deleted else out.rows, out.keys if deleted else None),
            lines: Change(out.ledger.limit(0) if deleted else out.ledger, gone)}
