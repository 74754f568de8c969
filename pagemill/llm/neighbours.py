"""Near-duplicate vectors by NN-descent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches, written
from pagemill.llm.graph import components


@dataclass(frozen=True)
class Descent:
    """Parameters.

    Lists start with ``k`` neighbours from ``orders`` random-projection orders, each vector compared with the
    next ``reach`` in an order. Then neighbours of neighbours are compared in up to ``rounds`` rounds, until
    fewer than ``settled`` of the lists' entries are new. ``members``: vectors of a local comparison at one
    node; larger neighbourhoods are dealt into several. A list is saturated if it is full of links; it grows by
    ``k`` neighbours outside its vector's component, as often as that finds links. ``audit_rows`` queries are held
    against all rows; below ``recall`` all lists are doubled and refined again, up to ``enlarge`` times, and the
    recall that was reached is told. ``block``: rows of a block in the exact comparison inside a component.
    ``run``: rows of one component that wait for the next component in an order.
    """

    threshold: float = 0.95
    k: int = 8
    orders: int = 6
    reach: int = 12
    rounds: int = 3
    settled: float = 0.02
    members: int = 32
    audit_rows: int = 256
    recall: float = 0.98
    enlarge: int = 2
    block: int = 256
    run: int = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy()
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _pairs_out(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    """Both directions of each pair."""
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((a, b))), pa.array(np.concatenate((b, a))), pa.array(np.concatenate((s, s)))], names=["u", "v", "s"]
    )


def _by_runs(keys: np.ndarray):
    """(start, stop) of the runs of equal values."""
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else [0]
    return zip(cuts[:-1], cuts[1:])


def _first_lists(vectors: DataFrame, p: Descent, width: int, seed: int = 11) -> DataFrame:
    """Directed neighbour candidates from orders by the signs of random projections: the next rows of another component.

    ``vectors`` has (id, component, x); at first every vector is a component of its own. Ties lie anywhere, so equal
    codes spread over range partitions instead of filling one task.
    """
    planes = np.random.default_rng(seed).standard_normal((p.orders, 30, width))

    def codes():
        weights = 1 << np.arange(29, -1, -1, dtype=np.int64)

        def one(batch: pa.RecordBatch):
            rows = _matrix(batch.column("x"))
            for order in range(p.orders if len(rows) else 0):
                code = ((rows @ planes[order].T) > 0) @ weights
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), order, np.int32)), pa.array(code.astype(np.int64)), *batch.columns], names=["order", "code", *batch.schema.names]
                )

        return one

    def compare():
        held: list[pa.RecordBatch] = []

        def one(batch: pa.RecordBatch):
            """The last run of a batch, or the end of a long one, waits for the next batch."""
            whole = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches() if held else [batch]
            if not whole or not whole[0].num_rows:
                return
            orders, ids, comps = (whole[0].column(c).to_numpy() for c in ("order", "id", "component"))
            rows = _matrix(whole[0].column("x"))
            ends = np.r_[np.flatnonzero((orders[1:] != orders[:-1]) | (comps[1:] != comps[:-1])) + 1, len(ids)]
            after = ends[np.searchsorted(ends, np.arange(len(ids)), "right")]
            for gap in range(p.reach):
                left = np.flatnonzero(after + gap < len(ids))
                right = after[left] + gap
                met = (orders[left] == orders[right]) & (comps[left] != comps[right])
                left, right = left[met], right[met]
                if len(left):
                    yield _pairs_out(ids[left], ids[right], np.einsum("ij,ij->i", rows[left], rows[right]))
            last = int(ends[-2]) if len(ends) > 1 else 0
            held[:] = [whole[0].slice(max(last, len(ids) - p.run))]

        return one

    dealt = map_batches(vectors.select("id", "component", "x"), "order int, code long, id long, component long, x array<double>", codes)
    parts = max(8, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartitionByRange(parts, "order", "code", "component", "id").sortWithinPartitions("order", "code", "component", "id")
    return map_batches(dealt, "u long, v long, s double", compare)


def _shortened(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each list; the window keeps only k rows a key and task before the shuffle."""
    nearest = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    return pairs.distinct().withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k).drop("place")


def _refined(lists: DataFrame, vectors: DataFrame, p: Descent) -> DataFrame:
    """Candidates from neighbours of neighbours.

    A node gathers the vectors of its neighbours in either direction and compares them among themselves;
    a large neighbourhood is dealt into parts of about ``members`` by hash. A pair goes on for an end
    whose list it improves; two of one component are no pair.
    """
    worst = lists.groupBy("u").agg(F.min("s").alias("worst"))
    sides = lists.select(F.col("u").alias("node"), F.col("v").alias("id")).union(lists.select(F.col("v").alias("node"), F.col("u").alias("id"))).distinct()
    degrees = sides.groupBy("node").agg(F.count("*").alias("degree"))
    carried = vectors.select("id", "component", "x").join(worst.select(F.col("u").alias("id"), "worst"), "id")
    dealt = (
        sides.join(degrees, "node")
        .withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("degree") / p.members)))
        .join(carried, "id")
        .select("node", "part", "id", "component", "worst", "x")
    )
    dealt = dealt.repartition("node", "part").sortWithinPartitions("node", "part")

    def make():
        def one(batch: pa.RecordBatch):
            ids, worst, rows = batch.column("id").to_numpy(), batch.column("worst").to_numpy(), _matrix(batch.column("x"))
            key, comps = batch.column("node").to_numpy() * 1_000_003 + batch.column("part").to_numpy(), batch.column("component").to_numpy()
            left, right, near = [], [], []
            for a, b in _by_runs(key):
                if b - a < 2:
                    continue
                s = rows[a:b] @ rows[a:b].T
                i, j = np.nonzero((s > worst[a:b, None]) & (comps[a:b, None] != comps[a:b]))
                left.append(ids[a + i])
                right.append(ids[a + j])
                near.append(s[i, j])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (left, right, near)], names=["u", "v", "s"])

        return one

    return map_batches(dealt, "u long, v long, s double", make)


def _counts_within(members: DataFrame, p: Descent) -> DataFrame:
    """(id, links): all pairs above the threshold inside each component, weighted by copies, block against block.

    A component of m vectors is dealt into ceil(m / block) parts; a task group meets two parts, and only
    sums by vector leave it.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("m")).withColumn("parts", F.ceil(F.col("m") / p.block).cast("int"))
    dealt = members.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = dealt.withColumn("with", other).select(
        "component", F.least("part", "with").alias("a"), F.greatest("part", "with").alias("b"), "part", "id", "copies", "x"
    )
    met = met.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "part")

    def make():
        held: list[pa.RecordBatch] = []

        def links(table: pa.RecordBatch):
            parts, ids, copies = table.column("part").to_numpy(), table.column("id").to_numpy(), table.column("copies").to_numpy()
            rows = _matrix(table.column("x"))
            cut = int(np.searchsorted(parts, parts[0], "right"))
            if cut == len(parts):
                if table.column("a")[0] != table.column("b")[0]:
                    return
                near = (rows @ rows.T >= p.threshold) & ~np.eye(len(rows), dtype=bool)
                yield ids, near @ copies
            else:
                near = rows[:cut] @ rows[cut:].T >= p.threshold
                yield ids[:cut], near @ copies[cut:]
                yield ids[cut:], near.T @ copies[:cut]

        def out(batch: pa.RecordBatch):
            key = np.stack([batch.column(c).to_numpy() for c in ("component", "a", "b")], 1)
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True])
            for a, b in zip(cuts[:-1], cuts[1:]):
                for ids, n in links(batch.slice(a, b - a)):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], names=["id", "links"])

        def one(batch: pa.RecordBatch):
            """The last group of a batch waits for the next one."""
            tables = [table for table in (*held, batch) if table.num_rows]
            if not tables:
                return
            whole = pa.Table.from_batches(tables).combine_chunks().to_batches()[0]
            key = np.stack([whole.column(c).to_numpy() for c in ("component", "a", "b")], 1)
            changes = np.flatnonzero((key[1:] != key[:-1]).any(1))
            cut = int(changes[-1]) + 1 if len(changes) else 0
            held[:] = [whole.slice(cut)]
            if cut:
                yield from out(whole.slice(0, cut))

        def rest():
            for batch in held:
                yield from out(batch)

        one.rest = rest
        return one

    found = map_batches(met, "id long, links long", make)
    return found.groupBy("id").agg(F.sum("links").alias("links"))


def _audit(vectors: DataFrame, p: Descent, total: int) -> DataFrame:
    """(id, links) of a bounded sample of queries, each held against all rows."""
    chance = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    queries = vectors.where(chance < min(1.0, p.audit_rows / max(total, 1))).select("id", "x").toArrow()
    if not queries.num_rows:
        return None
    sent = vectors.sparkSession.sparkContext.broadcast((queries.column("id").to_numpy(), np.array(queries.column("x").to_pylist())))

    def make():
        ids, rows = sent.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            near = (rows @ _matrix(batch.column("x")).T >= p.threshold) & (ids[:, None] != batch.column("id").to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array((near @ batch.column("copies").to_numpy()).astype(np.int64))], names=["id", "links"])

        return one

    return map_batches(vectors.select("id", "copies", "x"), "id long, links long", make).groupBy("id").agg(F.sum("links").alias("links"))


def _descend(lists: DataFrame, vectors: DataFrame, p: Descent, k: int, total: int) -> DataFrame:
    """Lists refined until few of their entries are new."""
    for _ in range(p.rounds):
        new = written(_shortened(lists.union(_refined(lists, vectors, p)), k), "lists")
        changed = new.join(lists, ["u", "v"], "left_anti").count()
        lists = new
        if changed <= p.settled * total * k:
            break
    return lists


def _unsaturated(vectors: DataFrame, lists: DataFrame, p: Descent, k: int, width: int) -> DataFrame:
    """Components of the linked vectors: (node, component).

    A list with k links may hide others behind them. Its vector's own component is settled by the exact comparison, so
    the list grows by neighbours outside of it: the vectors with such lists go through a descent of their own, in which
    two of one component are no neighbours. That is repeated for lists that are full again, until no list is saturated
    or none finds a link; each pass joins components, so passes end.
    """
    links = lists.where(F.col("s") >= p.threshold)
    groups = written(components(links.select("u", "v")), "groups")
    seed = 11
    while True:
        full = lists.groupBy("u").agg(F.count("*").alias("n"), F.min("s").alias("least")).where((F.col("n") >= k) & (F.col("least") >= p.threshold))
        members = vectors.join(full.select(F.col("u").alias("id")), "id").join(groups.select(F.col("node").alias("id"), "component"), "id")
        members = written(members.select("id", "component", "x"), "saturated")
        held = members.agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).first()
        if held["low"] == held["high"]:  # none, or all of one component
            return groups
        seed += 1
        lists = written(_shortened(_first_lists(members, p, width, seed), k), "lists")
        lists = _descend(lists, members, p, k, held["n"])
        found = lists.where(F.col("s") >= p.threshold).select("u", "v")
        if found.isEmpty():
            return groups
        groups = written(components(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).union(found)), "groups")


def _recall(audit: DataFrame | None, counts: DataFrame) -> float:
    """The smaller one of two recalls over the audited vectors that have links: that of links, and the mean of a vector's."""
    if audit is None:
        return 1.0
    met = audit.where("links > 0").join(counts.withColumnRenamed("links", "found"), "id", "left")
    found = F.least(F.coalesce("found", F.lit(0)), "links")
    seen = met.agg((F.sum(found) / F.sum("links")).alias("links"), F.avg(found / F.col("links")).alias("vectors")).first()
    return 1.0 if seen["links"] is None else min(seen["links"], seen["vectors"])


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", params: Descent = Descent()) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept, recall) for each row: vectors linked at cosine ``threshold`` or more.

    Cosines are computed in double precision. A null or zero vector, one that holds a null or a component that
    is not finite, and one whose length is not the most frequent one of the table is linked with nothing; so is
    a row without key, which is kept. Equal vectors are one node with a number of copies, so copies are never
    expanded into pairs. A full list whose every neighbour is linked may hide more links: the exact comparison
    inside components makes up for those inside, and the list grows for those between components. ``recall`` is what
    the audit of bounded size found in the end, the same in all rows. An empty table gives no rows; other columns are
    not read.
    """
    p = params
    spark = rows.sparkSession
    array = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    fine = F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(array, finite) & F.exists(array, lambda c: c != 0)
    marked = rows.select(F.col(key).cast("long").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), array).alias("raw"))
    widths = marked.where("raw is not null").groupBy(F.size("raw").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    width = widths["w"] if widths else 0
    # Scaled by the largest component first, so that no square overflows or vanishes.
    top = F.array_max(F.transform("raw", F.abs))
    marked = marked.withColumn("raw", F.when(F.size("raw") == width, F.transform("raw", lambda c: c / top + F.lit(0.0))))
    marked = written(marked, "marked")
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, c: a + c * c))
    vectors = written(
        marked.where("raw is not null")
        .groupBy("raw")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
        .select("id", "copies", F.transform("raw", lambda c: c / norm).alias("x")),
        "vectors",
    )
    total = vectors.count()
    if not total:
        return marked.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("recall"))
    k = p.k
    alone = vectors.withColumn("component", F.col("id"))
    lists = written(_shortened(_first_lists(alone, p, width), k), "lists")
    audit = _audit(vectors, p, total)
    audit = written(audit, "audit") if audit is not None else None
    for attempt in range(p.enlarge + 1):
        lists = _descend(lists, alone, p, k, total)
        groups = _unsaturated(vectors, lists, p, k, width)
        inside = groups.select(F.col("node").alias("id"), "component").join(vectors, "id")
        counts = written(_counts_within(inside, p), "counts")
        reached = _recall(audit, counts)
        if reached >= p.recall:
            break
        k *= 2
    nodes = (
        vectors.select("id", "copies")
        .join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
        .join(counts, "id", "left")
        .select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    # Rows find their node by the vector itself.
    named = nodes.join(vectors.select("id"), "id")
    keys = marked.where("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("id")).join(named, "id").drop("id")
    return (
        marked.join(keys, "raw", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
        .withColumn("recall", F.lit(float(reached)))
    )
