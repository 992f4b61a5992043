"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is its set of distinct 5-word shingles; two are linked when the
Jaccard similarity of their sets reaches the threshold, and a class of near
copies is a component of the links. Equal sets are one node from the start, so
a large group of equal texts is one node.

The forest has TREES orders of the nodes, each sorted by its own DEPTH hashes of
the signature. Nodes that agree in the first LEAST hashes of an order lie next
to each other and form a region. In a region of up to WIDE nodes all pairs are
candidates; in a wider one a node's candidates are its NEIGHBOURS successors,
those with the longest common prefix, so the depth adapts to how crowded the
order is there. Signatures drop hopeless candidates, and the links are confirmed
on the full sets: first each node's two best candidates, then all that still lie
between different components. At last every wide region, and every region at
the edge of a sorted part, is closed: its nodes outside its largest component
are compared, in blocks, with all of its nodes, by signature and then by the full
sets, where they lie in different components. So no cap hides a pair, and of a
crowded region's pairs only the links that join components leave a task.

A pair at the threshold of 0.85 shares no region in any of 16 orders with
probability 7e-6, and its signature hides it with probability 3e-5; both fall
fast above the threshold.

Results for special rows: a null text or one without words has an empty set,
links with nothing and stays; a null ``doc_id`` counts as larger than all
others; rows that repeat a ``doc_id`` each get their component.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import small_side, stored, text_or_empty
from .components import connect
from .wordhash import Hasher, chunks, cut_words, mix

SHINGLE = 5
PERCENT = 85  # links: 100 * intersection >= PERCENT * union
TREES, DEPTH, LEAST = 16, 8, 4
HASHES = TREES * DEPTH
WIDE, NEIGHBOURS = 32, 4
BLOCK = 1024
MATCHES = 92  # of 128 signature values, four standard deviations under the threshold
LAST_ID = (1 << 63) - 1


@functools.lru_cache(maxsize=None)
def _hashers():
    rng = np.random.Generator(np.random.PCG64(5))
    return Hasher(11), [rng.integers(1, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2)]


def _shingle_sets(texts: pa.Array):
    """Distinct shingle hashes of a group of texts, sorted within each, and each text's bounds among them."""
    hasher, _ = _hashers()
    n = len(texts)
    data, doc, first, end = cut_words(texts, lower=True)
    word = hasher.words(data, first, end)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    count = np.diff(bounds)
    start = np.flatnonzero(doc[:max(0, len(word) - SHINGLE + 1)] == doc[SHINGLE - 1:])
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    first = np.concatenate([start, bounds[:-1][short]])
    past = np.concatenate([start + SHINGLE, bounds[1:][short]])
    owner = np.concatenate([doc[start], short])
    value = hasher.windows(word, first, past)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(n + 1))


def _signatures(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HASHES 16-bit values for each run of ``value`` that begins at ``starts``."""
    _, (low_by, high_by) = _hashers()
    low, high = value.astype(np.uint32), (value >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), HASHES), dtype=">u2")
    for j in range(HASHES):
        least = np.minimum.reduceat(low * low_by[j] + high * high_by[j], starts)
        out[:, j] = (mix(least.astype(np.uint64) + np.uint64(j << 32)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"),
                       F.xxhash64(text).alias("t"), text.alias("text"))


def _profile(docs: DataFrame) -> DataFrame:
    """Per row: shingle count, a 128-bit key of the set, the signature (empty without shingles)."""

    def run(batches):
        for batch in batches:
            for lo, texts in chunks(batch.column(2)):
                n = len(texts)
                value, bounds = _shingle_sets(texts)
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                keys = np.zeros((2, n), dtype=np.uint64)
                signature = [b""] * n
                if len(some):
                    starts = bounds[:-1][some]
                    for k in range(2):  # the sets are distinct and sorted, so a sum is a key of the set
                        keys[k, some] = mix(np.add.reduceat(mix(value + np.uint64((0x9E3779B97F4A7C15, 0x3C6EF372FE94F82B)[k])), starts))
                    for i, s in zip(some, _signatures(value, starts)):
                        signature[i] = s.tobytes()
                yield pa.record_batch(
                    [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(size, pa.int64()),
                     pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(signature, pa.binary())],
                    names=["d", "t", "n", "set_a", "set_b", "signature"])

    return _keyed(docs).mapInArrow(run, "d long, t long, n long, set_a long, set_b long, signature binary")


def _forest(nodes: DataFrame) -> DataFrame:
    """Entries (tree, prefix, rest, v, n, sketch) of the nodes that share a region in that order."""

    def prefixes(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=">u8").reshape(-1, TREES, DEPTH // 4)
            rows, trees = np.divmod(np.arange(batch.num_rows * TREES), TREES)
            yield pa.record_batch(
                [pa.array(trees.astype(np.int32)), pa.array(sig[:, :, 0].astype(np.uint64).view(np.int64).ravel()),
                 batch.column(0).take(pa.array(rows))], names=["tree", "prefix", "v"])

    def entries(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(-1, HASHES * 2)
            lists = batch.column(3)
            at = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            trees = lists.flatten().to_numpy()
            halves = sig.reshape(-1, TREES, 16)[at, trees].copy().view(">u8").astype(np.uint64).view(np.int64)
            sketch = [s.tobytes() for s in np.ascontiguousarray(sig[:, 1::2])]
            yield pa.record_batch(
                [pa.array(trees, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                 batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)),
                 pa.array(sketch, pa.binary()).take(pa.array(at))],
                names=["tree", "prefix", "rest", "v", "n", "sketch"])

    places = nodes.select("v", "signature").mapInArrow(prefixes, "tree int, prefix long, v long")
    shared = places.groupBy("tree", "prefix").count().filter("count > 1").drop("count")
    shared = stored(shared, "minhash-shared")  # written, so that the join below can split a crowded region
    live = places.join(small_side(shared), ["tree", "prefix"]).groupBy("v").agg(F.collect_set("tree").alias("trees"))
    rows = nodes.join(live, "v").select("v", "n", "signature", "trees")
    return rows.mapInArrow(entries, "tree int, prefix long, rest long, v long, n long, sketch binary")


PAIRS = "kind string, a long, b long, likeness int"


def _pairs_of(v, n, sketch, i, j):
    """Of the index pairs (i, j) those that may be linked: (smaller v, larger v, equal signature values)."""
    near = 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
    i, j = i[near], j[near]
    same = (sketch[i] == sketch[j]).sum(axis=1)
    good = same >= MATCHES
    i, j = i[good], j[good]
    return np.minimum(v[i], v[j]), np.maximum(v[i], v[j]), same[good]


def _candidates(entries: DataFrame) -> DataFrame:
    """Walk the sorted orders: candidate pairs (kind 'pair'), and the regions to be closed later (kind 'region')."""
    upper = [np.triu_indices(k, 1) for k in range(WIDE + 1)]

    def walk(batches):
        held: list = []       # the current region's rows; in a wide one the last NEIGHBOURS of them
        region, wide, first = None, False, True
        out: list[tuple] = []

        def flush(edge: bool) -> None:
            if region is None:
                return
            if wide or edge:
                out.append(("region", region[0], region[1], 0))
            if not wide and len(held) > 1:
                v = np.array([r[0] for r in held])
                n = np.array([r[1] for r in held])
                sketch = np.frombuffer(b"".join([r[2] for r in held]), dtype=np.uint8).reshape(len(held), -1)
                out.extend(("pair", *x) for x in zip(*map(np.ndarray.tolist, _pairs_of(v, n, sketch, *upper[len(held)]))))

        def step(row) -> None:
            """A further row of a wide region, against the rows just before it."""
            v = np.array([r[0] for r in held] + [row[0]])
            n = np.array([r[1] for r in held] + [row[1]])
            sketch = np.frombuffer(b"".join([r[2] for r in held] + [row[2]]), dtype=np.uint8).reshape(len(v), -1)
            i = np.arange(len(held))
            out.extend(("pair", *x) for x in zip(*map(np.ndarray.tolist, _pairs_of(v, n, sketch, i, np.full(len(i), len(held))))))

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5)]
            for tree, prefix, *row in zip(*columns):
                if region != (tree, prefix):
                    flush(first)
                    first = first and region is None
                    region, wide, held = (tree, prefix), False, []
                if wide:
                    step(row)
                    held = held[-(NEIGHBOURS - 1):] + [row]
                elif len(held) == WIDE:
                    wide, rows, held = True, held + [row], []
                    for r in rows:
                        if held:
                            step(r)
                        held = held[-(NEIGHBOURS - 1):] + [r]
                else:
                    held.append(row)
            if out:
                yield _pair_batch(out)
                out.clear()
        flush(True)
        if out:
            yield _pair_batch(out)

    order = ["tree", "prefix", "rest", "v"]
    return entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, PAIRS)


def _pair_batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, a, b, likeness = zip(*rows)
    return pa.record_batch([pa.array(kind), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(likeness, pa.int32())],
                           names=["kind", "a", "b", "likeness"])


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, shingles) of ``nodes`` (v, d, t): the set of one of the node's rows, 48 bits a shingle."""

    def run(batches):
        for batch in batches:
            for lo, texts in chunks(batch.column(1)):
                value, bounds = _shingle_sets(texts)
                short = np.ascontiguousarray(value.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
                raw = np.ascontiguousarray(short).tobytes()
                yield pa.record_batch(
                    [batch.column(0).slice(lo, len(texts)),
                     pa.array([raw[6 * a:6 * b] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                    names=["v", "shingles"])

    rows = _keyed(docs).join(small_side(nodes), ["d", "t"]).dropDuplicates(["v"]).select("v", "text")
    return rows.mapInArrow(run, "v long, shingles binary")


def _unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = _unpack(x), _unpack(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.record_batch([kept.column(0), kept.column(1)], names=["a", "b"])

    rows = (pairs.select("a", "b").join(sets.withColumnsRenamed({"v": "a", "shingles": "x"}), "a")
            .join(sets.withColumnsRenamed({"v": "b", "shingles": "y"}), "b"))
    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    rows = (pairs.join(labels.withColumnsRenamed({"v": "a", "c": "ca"}), "a")
            .join(labels.withColumnsRenamed({"v": "b", "c": "cb"}), "b"))
    return rows.filter("ca <> cb").select(*pairs.columns)


def _outsiders(entries: DataFrame, regions: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes of ``regions`` that hold more than one component, each with the blocks it is compared in.

    A region's nodes outside its largest component are asked against all its
    nodes; both are dealt into blocks, and every pair of blocks is one group.
    """
    members = (entries.join(small_side(regions), ["tree", "prefix"])
               .join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))
               .select("tree", "prefix", "v", "n", "sketch", "c"))
    members = stored(members, "minhash-members")
    by_class = members.groupBy("tree", "prefix", "c").agg(F.count(F.lit(1)).alias("k"))
    sizes = by_class.groupBy("tree", "prefix").agg(
        F.sum("k").alias("size"), F.max("k").alias("largest"), F.max(F.struct("k", "c")).getField("c").alias("main"))
    sizes = sizes.filter("largest < size").select(
        "tree", "prefix", "main", F.ceil(F.col("size") / BLOCK).cast("int").alias("target_blocks"),
        F.ceil((F.col("size") - F.col("largest")) / BLOCK).cast("int").alias("query_blocks"))
    return stored(members.join(small_side(stored(sizes, "minhash-sizes")), ["tree", "prefix"]), "minhash-outsiders")


def _closing_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components, by the full sets; a group returns as few as join what it can join."""
    rows = rows.join(sets, "v")
    block = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["tree", "prefix", "v", "n", "sketch", "c", "shingles"]
    targets = rows.select(*columns, F.lit(False).alias("query"), block("target_blocks").alias("tb"),
                          every("query_blocks").alias("qb"))
    asked = rows.filter("c <> main").select(*columns, F.lit(True).alias("query"), block("query_blocks").alias("qb"),
                                            every("target_blocks").alias("tb"))

    def compare(group):
        import pandas as pd

        sketch = np.frombuffer(b"".join(group["sketch"]), dtype=np.uint8).reshape(len(group), -1)
        v, n, c = (group[x].to_numpy().copy() for x in ("v", "n", "c"))
        held = [_unpack(x) for x in group["shingles"]]
        ask = group["query"].to_numpy(dtype=bool)
        targets = np.flatnonzero(~ask)
        found: list[tuple[int, int]] = []
        if len(targets):
            known, place = np.unique(np.concatenate([held[t] for t in targets]), return_inverse=True)
            ends = np.cumsum([len(held[t]) for t in targets])
            in_query = np.zeros(len(known), dtype=bool)
            for q in np.flatnonzero(ask):
                near = ((c[targets] != c[q]) & (100 * np.minimum(n[targets], n[q]) >= PERCENT * np.maximum(n[targets], n[q]))
                        & ((sketch[targets] == sketch[q]).sum(axis=1) >= MATCHES))
                if not near.any():
                    continue
                at = np.searchsorted(known, held[q])
                at = at[at < len(known)]
                at = at[np.isin(known[at], held[q], assume_unique=True)]
                in_query[at] = True
                both = np.diff(np.concatenate([[0], np.cumsum(in_query[place])])[np.concatenate([[0], ends])])
                in_query[at] = False
                linked = near & (100 * both >= PERCENT * (n[q] + n[targets] - both))
                for t in targets[linked]:
                    if c[t] != c[q]:
                        found.append((min(v[q], v[t]), max(v[q], v[t])))
                        c[c == c[t]] = c[q]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return (targets.unionByName(asked).groupBy("tree", "prefix", "qb", "tb")
            .applyInPandas(compare, "a long, b long").distinct())


def near_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, t) per row of ``docs`` (doc_id, text).

    ``component_id``: the least doc_id reachable by links; ``kept``: it is the row's own.
    ``t`` tells rows of one doc_id with different texts apart.
    """
    profile = stored(_profile(docs), "minhash-profile")
    nodes = (profile.filter("n > 0").groupBy("set_a", "set_b")
             .agg(F.min("d").alias("least_d"), F.max("d").alias("last_d"), F.min(F.struct("d", "t")).alias("one"),
                  F.first("n").alias("n"), F.first("signature").alias("signature"))
             .select(F.monotonically_increasing_id().alias("v"), "set_a", "set_b", "least_d", "last_d",
                     F.col("one.d").alias("d"), F.col("one.t").alias("t"), "n", "signature"))
    nodes = stored(nodes, "minhash-nodes")
    entries = stored(_forest(nodes), "minhash-forest")
    walked = stored(_candidates(entries), "minhash-walk")
    pairs = stored(walked.filter("kind = 'pair'").groupBy("a", "b").agg(F.max("likeness").alias("likeness")),
                   "minhash-pairs")
    regions = walked.filter("kind = 'region'").select(F.col("a").cast("int").alias("tree"), F.col("b").alias("prefix"))

    def named(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(F.array("a", "b")).alias("v")).distinct()

    live = stored(named(pairs), "minhash-live")
    labels = stored(live.select("v", F.col("v").alias("c")), "minhash-labels")
    sets = stored(_sets(docs, nodes.join(live, "v", "left_semi").select("v", "d", "t")), "minhash-sets")

    ends = pairs.select(F.col("a").alias("v"), "a", "b", "likeness").unionByName(
        pairs.select(F.col("b").alias("v"), "a", "b", "likeness"))
    best = ends.withColumn("k", F.row_number().over(
        Window.partitionBy("v").orderBy(F.desc("likeness"), "a", "b"))).filter("k <= 2")
    tried = stored(best.select("a", "b").distinct(), "minhash-tried")
    labels = connect(labels, stored(_confirm(tried, sets), "minhash-links"))

    rest = stored(_between(pairs.select("a", "b").join(tried, ["a", "b"], "left_anti"), labels), "minhash-rest")
    labels = connect(labels, stored(_confirm(rest, sets), "minhash-links"))

    rows = _outsiders(entries, stored(regions.distinct(), "minhash-regions"), labels)
    fresh = stored(rows.select("v").distinct().join(live, "v", "left_anti"), "minhash-fresh")
    sets = sets.unionByName(_sets(docs, nodes.join(fresh, "v", "left_semi").select("v", "d", "t")))
    labels = labels.unionByName(fresh.select("v", F.col("v").alias("c")))
    labels = connect(labels, stored(_closing_links(rows, sets), "minhash-links"))

    # classes with more than one row or more than one node; every other row stands alone
    classes = nodes.join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))
    least = classes.groupBy("c").agg(F.min("least_d").alias("least"), F.max("last_d").alias("last"))
    least = stored(least.filter("last > least"), "minhash-least")
    grouped = stored(classes.join(small_side(least), "c").select("set_a", "set_b", "least"), "minhash-classes")
    rows = profile.join(small_side(grouped), ["set_a", "set_b"], "left")
    own, least_id = F.col("d"), F.coalesce("least", "d")
    null_last = lambda x: F.nullif(x, F.lit(LAST_ID))
    return rows.select(null_last(own).alias("doc_id"), F.col("n").alias("n_shingles"),
                       null_last(least_id).alias("component_id"), (own == least_id).alias("kept"), "t")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are their component's least ``doc_id``."""
    dropped = near_dedup(docs).filter("NOT kept").select(F.col("doc_id").alias("drop_id"), F.col("t").alias("drop_t"))
    dropped = small_side(stored(dropped, "minhash-dropped"))
    same = docs["doc_id"].eqNullSafe(dropped["drop_id"]) & (F.xxhash64(text_or_empty()) == dropped["drop_t"])
    return docs.join(dropped, same, "left_anti")
