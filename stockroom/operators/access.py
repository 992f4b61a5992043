"""Access control and memberships.

``authorize_requests`` answers the route guard for a whole batch: the
permission table is a fixed ``CASE`` expression (no join), and the caller's
role comes from one join with ``user_store`` on its key ``(user_id,
store_id)``. The membership procedures test their conditions in the
source's order; the first failing one is the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import largest, number_rows

# Roles allowed per action, from the route guards of the
# source (None: any member of the store; the handler checks membership only).
PERMISSIONS: dict[str, tuple[str, ...] | None] = {
    "create_sale": ("admin", "manager", "cashier"),
    "list_sales": None, "get_sale": None, "get_sale_items": None, "sales_report": None,
    "update_sale": ("admin", "manager"), "delete_sale": ("admin", "manager"),
    "create_purchase": ("admin", "manager"),
    "list_purchases": None, "get_purchase": None, "get_purchase_items": None,
    "update_purchase": ("admin", "manager"), "delete_purchase": ("admin", "manager"),
    "list_products": ("admin", "manager", "staff"), "get_product": ("admin", "manager", "staff"),
    "create_product": ("admin", "manager"), "update_product": ("admin", "manager"),
    "delete_product": ("admin",),
    "add_review": ("admin", "manager", "staff"), "list_reviews": ("admin", "manager", "staff"),
    "create_supplier": ("admin", "manager"), "list_suppliers": None, "get_supplier": None,
    "update_supplier": ("admin", "manager"), "delete_supplier": ("admin", "manager"),
    "supplier_purchases": None,
    "create_category": ("admin", "manager"), "list_categories": None, "get_category": None,
    "update_category": ("admin", "manager"), "delete_category": ("admin", "manager"),
    "get_store": ("admin", "manager", "staff"), "update_store": ("admin",), "delete_store": ("admin",),
}
# Roles the membership procedures accept.
MEMBER_ROLES = ("admin", "manager", "staff")

# Rows of a listing and callers that meet in one cell, about. Callers are narrow and copied more often; the rows
# of one block of them are held by the join, in memory below 4,096.
LISTING_BLOCK, CALLER_BLOCK = 500, 3_000

ACCESS_DENIED = "Access denied"
INSUFFICIENT = "Insufficient permissions"


def role_allowed(action: Column, role: Column) -> Column:
    """Boolean: may ``role`` perform ``action``? NULL for an unknown action."""
    out = None
    for act, roles in PERMISSIONS.items():
        ok = role.isNotNull() if roles is None else role.isin(*roles)
        out = F.when(action == act, ok) if out is None else out.when(action == act, ok)
    return out


def authorize_requests(requests: DataFrame, user_store: DataFrame, action: str | None = None) -> DataFrame:
    """Add ``role``, ``allowed`` and ``reason`` to each request.

    ``requests`` has ``user_id``, ``store_id`` and an ``action`` column (or
    pass one ``action`` for all). Reasons: 'Access denied' (no membership),
    'Insufficient permissions' (role not allowed), 'Unknown action'.
    Of several memberships of a user in a store (the join procedure doesn't
    test for one) the role that comes first by name counts, so a request is
    answered once.
    """
    if action is not None:
        requests = requests.withColumn("action", F.lit(action))
    us = user_store.groupBy("user_id", "store_id").agg(F.min("role").alias("member_role"))
    j = requests.join(us, ["user_id", "store_id"], "left")
    ok = role_allowed(F.col("action"), F.col("member_role"))
    reason = (F.when(F.col("member_role").isNull(), F.lit(ACCESS_DENIED))
              .when(ok.isNull(), F.lit("Unknown action"))
              .when(~ok, F.lit(INSUFFICIENT)))
    return (j.withColumn("reason", reason)
            .withColumn("allowed", F.col("reason").isNull())
            .withColumnRenamed("member_role", "role"))


def split_authorized(requests: DataFrame, user_store: DataFrame, action: str
                     ) -> tuple[DataFrame, DataFrame]:
    """(allowed requests with their original columns, rejects with ``reason``)."""
    cols = requests.columns
    a = authorize_requests(requests, user_store, action)
    return (a.filter("allowed").select(*cols),
            a.filter(~F.col("allowed")).select(*cols, "reason"))


def for_callers(listing: DataFrame, callers: DataFrame, user_store: DataFrame, action: str
                ) -> tuple[DataFrame, DataFrame]:
    """A listing as each caller (user_id, store_id) may read it, and the callers turned away.

    Every list and detail handler first tests the caller's membership. Rows of
    ``listing`` (with ``store_id``) come with ``caller_id``, once for every
    caller of their store that the guard lets through; the rest are returned
    with the reason.
    """
    ok, denied = split_authorized(callers.select("user_id", "store_id").distinct(), user_store, action)
    rows = pairs_by_blocks(listing, ok.withColumnRenamed("user_id", "caller_id"), "store_id")
    return rows.select("caller_id", *listing.columns), denied


def pairs_by_blocks(left: DataFrame, right: DataFrame, key: str, left_rows: int = LISTING_BLOCK,
                    right_rows: int = CALLER_BLOCK) -> DataFrame:
    """The inner join of ``left`` and ``right`` on ``key``, spread by the rows that it gives.

    For few keys with many rows on both sides: the tables are small next to
    their join, and tasks sized by what they read would give it all in one.
    The rows of a key are dealt by their hash into blocks of about
    ``left_rows`` and ``right_rows``; each pair of blocks meets in one cell, and
    cells are spread over the tasks. A row is copied once for every block of
    the other side, so of the rows given one in ``left_rows`` and one in
    ``right_rows`` is shuffled.
    """
    spark = left.sparkSession
    # a given number isn't lowered by the size of what is read
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    blocks = (left.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / left_rows).alias("_lefts"))
              .join(right.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / right_rows).alias("_rights")), key))

    def cells(df: DataFrame, own: str, other: str) -> DataFrame:
        hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
        return (df.join(blocks, key)
                .withColumn(f"_{own}", F.pmod(F.xxhash64(*hashed), F.col(f"_{own}s")))
                .repartition(n, *hashed)  # the copies too are made by all tasks
                .withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(f"_{other}s") - 1)))
                .drop("_lefts", "_rights")
                .repartition(n, key, "_left", "_right"))

    return (cells(left, "left", "right").join(cells(right, "right", "left"), [key, "_left", "_right"])
            .drop("_left", "_right"))


def accept_user_requests(requests: DataFrame, users: DataFrame, stores: DataFrame
                         ) -> tuple[DataFrame, DataFrame]:
    """Join requests: user must exist, then store, then the role be valid.

    Returns (new memberships ``(user_id, store_id, role)``, rejects with reason).
    """
    u = users.select("user_id", F.lit(True).alias("_u"))
    s = stores.select(F.col("id").alias("store_id"), F.lit(True).alias("_s"))
    j = requests.join(u, "user_id", "left").join(s, "store_id", "left")
    reason = (F.when(F.col("_u").isNull(), "User does not exist")
              .when(F.col("_s").isNull(), "Store does not exist")
              .when(~F.col("role").isin(*MEMBER_ROLES), "Invalid role"))
    j = j.withColumn("reason", reason)
    ok = j.filter(F.col("reason").isNull()).select("user_id", "store_id", "role")
    bad = j.filter(F.col("reason").isNotNull()).select("user_id", "store_id", "role", "reason")
    return ok, bad


def update_user_roles(requests: DataFrame, user_store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set roles: the membership must exist, then the role be valid.

    Returns (new ``user_store`` snapshot, rejects). Several valid requests for
    one membership apply in ``request_id`` order (the last one stays).
    """
    # a membership that is stored twice answers a request once
    us = user_store.select("user_id", "store_id").distinct().withColumn("_m", F.lit(True))
    j = requests.join(us, ["user_id", "store_id"], "left")
    reason = (F.when(F.col("_m").isNull(), "User is not associated with this store")
              .when(~F.col("role").isin(*MEMBER_ROLES), "Invalid role"))
    j = j.withColumn("reason", reason)
    bad = j.filter(F.col("reason").isNotNull()).select("request_id", "user_id", "store_id", "role", "reason")
    valid = j.filter(F.col("reason").isNull())
    # last valid request per membership: partial max, then join back (no hot-group window)
    last_id = valid.groupBy("user_id", "store_id").agg(F.max("request_id").alias("request_id"))
    last = (valid.join(last_id, ["user_id", "store_id", "request_id"], "left_semi")
            .groupBy("user_id", "store_id").agg(F.max("role").alias("new_role")))
    snap = (user_store.join(last, ["user_id", "store_id"], "left")
            .select("user_id", "store_id", F.coalesce("new_role", "role").alias("role")))
    return snap, bad


def import_users(requests: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add users whose e-mail is new (exact match); the first request per e-mail wins.

    Returns (new users ``(user_id, name, email)`` with ids above the largest,
    in ``request_id`` order; rejects with reason 'User already exists'). No
    credentials.
    """
    known = users.select("email").distinct().withColumn("_k", F.lit(True))
    first = requests.groupBy("email").agg(F.min("request_id").alias("_first"))
    j = requests.join(known, "email", "left").join(first, "email", "left")
    ok_cond = F.col("_k").isNull() & (F.col("request_id") == F.col("_first"))
    ok = number_rows(j.filter(ok_cond), ["request_id"], "user_id", largest(users, "user_id"))
    bad = j.filter(~ok_cond).select("request_id", "name", "email", F.lit("User already exists").alias("reason"))
    return ok.select("user_id", "name", "email"), bad
