"""Near-duplicate documents by bottom-k sketches from one hash function.

1. Every document gets its set of word shingles (64-bit hashes). Documents with one set are one class.
2. A class keeps the k smallest hashes of its set, its sketch. Retained values point back to classes
   (inverted lists). Of two sketches that overlap enough, the rarest values must overlap too, so only
   those are listed: rare first in one order for all, that of the classes which hold them. A list
   belongs to two values that are neighbours in that order. Lists of single values grow with the corpus;
   those of two stay short, and each value that two sets do not share parts at most one pair of neighbours:
   whole sets of union size u >= 5 keep 0.6 u - 1 >= 2 lists in common (smaller ones are equal or unlinked).
3. Long lists link their members to a few centres first. What that joins needs no further pairs. Members
   of long lists that are still apart are listed anew, by their full sets: of n values those n - ceil(0.8 n) + 1
   that the fewest components hold, as two linked sets have one of these in common. Most members only share a
   passage with others, which is not among the rarest fifth of their values, and meet nobody.
4. Where these lists are long too, their members meet in blocks of bounded size. Common values are counted
   there, so only links leave a block.
5. Pairs of short lists of either kind are filtered by the similarity that the sketch of their union
   estimates, and the rest is verified on full sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches, written
from pagemill.llm.graph import components
from pagemill.llm.shingles import shingle_set


@dataclass(frozen=True)
class Sketching:
    """Parameters of the search.

    ``width`` words a shingle; link at ``percent`` / 100 Jaccard similarity or more; ``k`` values a
    sketch. ``slack`` is the share of a cut sketch that a pair must have in common to be found (0.5:
    a pair at 0.8 misses it by six standard deviations at k = 64), and ``shared`` the lists that two
    sketches of 32 values or more must share. Uncut sketches are in the lists of all their neighbouring
    values, so their links are all found, whatever the frequency of the values. Lists of more than ``long_list``
    members take the star step first, each member with ``centres`` of the centres it has most lists with,
    and then blocks of ``block`` rows or ``block_values`` values, whichever comes first. ``estimate``: estimated
    similarity from which a pair is verified.
    """

    width: int = 2
    percent: int = 80
    k: int = 64
    slack: float = 0.5
    shared: int = 2
    long_list: int = 16
    centres: int = 2
    block: int = 1024
    block_values: int = 1 << 18
    estimate: float = 0.6

    def least_common(self, size: int) -> int:
        """Sketch values that a linked pair has in common at least, for a set of ``size`` shingles."""
        kept = min(size, self.k)
        whole = size * 100 <= self.k * self.percent  # then the partner's set is not cut either
        return -(-size * self.percent // 100) if whole else int(np.ceil(kept * self.slack))

    def listed(self, size: int) -> int:
        """How many of the rarest retained values are listed; all of a set that is not cut or can be linked to one that is not."""
        kept = min(size, self.k)
        return kept if size * self.percent <= self.k * 100 else min(kept, kept - self.least_common(size) + 4)


def _sketch_documents(docs: DataFrame, p: Sketching) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sketch): d1 and d2 identify the set."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, first, second, sketches = [], [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_py(), p.width)
                sizes.append(len(found))
                sketches.append(found[: p.k])
                with np.errstate(over="ignore"):
                    first.append(int(found.sum()))
                    second.append(int((found * (found >> 17 | 1)).sum()))
            lengths = np.fromiter(map(len, sketches), np.int32, len(sketches))
            values = np.concatenate(sketches) if sketches else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(values))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists],
                names=["doc_id", "n_shingles", "d1", "d2", "sketch"],
            )

        return one

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>",
        make,
    )


def _postings(classes: DataFrame, p: Sketching) -> DataFrame:
    """(value, rep, n): a row for each two neighbours among the rarest retained values of a class.

    Values that no other class holds are left out before; ``value`` is a hash of both. Counts are those of
    whole values over all classes, so the rows follow the values that classes share at any size of the corpus.
    Rows that share a doc_id can be classes of one ``rep``, which ``d1`` tells apart.
    """
    held = classes.select("rep", "n", "d1", F.explode("sketch").alias("value"))
    shared = held.groupBy("value").agg(F.count("*").alias("times")).where("times > 1")
    rare = held.join(shared, "value").groupBy("rep", "n", "d1").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("rare"))
    # Values of one class alone are rarer than these: they count among those that are listed, but reach no other class.
    alone = F.least("n", F.lit(p.k)) - F.size("rare")
    cut = p.k * 100 // p.percent + 1  # sets of this size or more list equally many
    listed = F.when(F.col("n") < cut, F.least("n", F.lit(p.k))).otherwise(p.listed(cut))
    later = F.slice("rare", 2, F.greatest(listed - alone - 1, F.lit(0)).cast("int"))
    pairs = F.transform(later, lambda x, i: F.xxhash64(F.get("rare", i)["value"], x["value"]))
    return rare.select(F.explode(pairs).alias("value"), "rep", "n")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def _estimated(pairs: DataFrame, classes: DataFrame, p: Sketching) -> DataFrame:
    """Pairs (a, b) whose union sketch does not rule them out; ``sure`` where the sketches are the whole sets."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            left, right = batch.column("sa"), batch.column("sb")
            lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
            lv, rv = left.values.to_numpy(), right.values.to_numpy()
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            whole = (na <= p.k) & (nb <= p.k)
            for i in range(batch.num_rows):
                x, y = lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]]
                both = np.sort(np.concatenate((x, y)))
                twice = both[1:] == both[:-1]
                if whole[i]:
                    common = int(twice.sum())
                    keep[i] = common * 100 >= (len(both) - common) * p.percent
                else:
                    union = np.r_[True, ~twice]
                    last = min(p.k, int(union.sum()))
                    end = int(np.searchsorted(np.cumsum(union), last, "right"))  # the first k of the union
                    keep[i] = int(twice[: max(end - 1, 0)].sum()) >= last * p.estimate
            out = pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(whole)], names=["a", "b", "sure"]
            )
            return out.filter(pa.array(keep))

        return one

    ends = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep")))
    classes = _only(classes.select("rep", "n", "sketch"), "rep", ends, "rep long, n long, sketch array<long>")
    with_a = pairs.join(classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    with_b = with_a.join(classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    return map_batches(with_b.select("a", "b", "na", "nb", "sa", "sb"), "a long, b long, sure boolean", make)


SLOT_BITS = 22


def _slot(column: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column), 64 - SLOT_BITS).cast("int")


def _only(rows: DataFrame, key: str, wanted: DataFrame, schema: str, make_row=None) -> DataFrame:
    """``rows`` whose ``key`` is among the keys of ``wanted``, and a few others.

    A bitmap of fixed size (2**SLOT_BITS) goes to the tasks and spares the other rows the trip through
    a shuffle. ``make_row``: what makes rows of ``schema`` from a batch of those that pass, once a task.
    """
    slots = wanted.select(_slot(key).alias("slot")).distinct().toArrow()
    bitmap = np.zeros(1 << SLOT_BITS, bool)
    bitmap[slots.column("slot").to_numpy()] = True
    sent = rows.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def make():
        on = np.unpackbits(sent.value)
        change = make_row() if make_row else None

        def one(batch: pa.RecordBatch):
            part = batch.filter(pa.array(on[batch.column(batch.num_columns - 1).to_numpy()] > 0))
            part = part.select(part.schema.names[:-1])
            return change(part) if change else part

        return one

    return map_batches(rows.withColumn("__slot", _slot(key)), schema, make)


def _full_sets(docs: DataFrame, wanted: DataFrame, p: Sketching) -> DataFrame:
    """(rep, set) of the wanted classes."""

    def make_row():
        def change(batch: pa.RecordBatch):
            for i in range(batch.num_rows):
                found = shingle_set(batch.column("text")[i].as_py(), p.width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("rep").slice(i, 1),
                        pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found)),
                    ],
                    names=["rep", "set"],
                )

        return change

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    return _only(rows, "rep", wanted, "rep long, set array<long>", make_row)


def _verified(pairs: DataFrame, docs: DataFrame, p: Sketching) -> DataFrame:
    """Linked pairs (u, v): the sure ones, and of the others those whose full sets are similar enough."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = batch.column("xa")[i].values.to_numpy(), batch.column("xb")[i].values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = common * 100 >= (len(x) + len(y) - common) * p.percent
            return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["u", "v"]).filter(pa.array(keep))

        return one

    open_pairs = pairs.where("not sure").select("a", "b")
    wanted = open_pairs.select(F.col("a").alias("rep")).union(open_pairs.select(F.col("b").alias("rep"))).distinct()
    sets = written(_full_sets(docs, wanted, p).join(wanted, "rep", "left_semi"), "sets")
    joined = open_pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("xa")), "a").join(
        sets.select(F.col("rep").alias("b"), F.col("set").alias("xb")), "b"
    )
    exact = map_batches(joined.select("a", "b", "xa", "xb"), "u long, v long", make)
    return exact.union(pairs.where("sure").select("a", "b"))


def _rarest(sets: DataFrame, p: Sketching) -> DataFrame:
    """(value, rep, n, component): of each set (rep, n, component, set) the values of which two linked sets share one.

    Linked sets have ``percent`` of either in common, so in one order for all the first common value has at least that
    many after it in both. The order is that of the components that hold a value, rare first. Values of one component
    alone come before all others and reach no other component, so they are counted but not listed.
    """
    held = sets.select("rep", "n", "component", F.explode("set").alias("value"))
    shared = held.select("value", "component").distinct().groupBy("value").agg(F.count("*").alias("times")).where("times > 1")
    rare = held.join(shared, "value").groupBy("rep", "n", "component").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("rare"))
    listed = F.expr(f"cast(n - (n * {p.percent} + 99) div 100 + 1 - (n - size(rare)) as int)")
    first = F.slice("rare", 1, F.greatest(listed, F.lit(0)))
    return rare.select(F.explode(F.transform(first, lambda x: x["value"])).alias("value"), "rep", "n", "component")


def _side(members: list[tuple], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all values of the members' sets that are in the vocabulary, by column."""
    values = np.concatenate([m[2] for m in members])
    rows = np.repeat(np.arange(len(members)), [len(m[2]) for m in members])
    columns = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
    there = vocabulary[columns] == values
    order = np.argsort(columns[there], kind="stable")
    return rows[there][order], columns[there][order]


#: Of all pairs of a block, the part from which a value's pairs are counted by a product of matrices, and one by one below.
DENSE = 1 / 200
#: Pairs of rows that are counted one by one at a time.
PAIRS = 1 << 20


def _common(one: list[tuple], right: list[tuple]) -> np.ndarray:
    """How many values each two sets of (rep, component, set) have in common."""
    out = np.zeros((len(one), len(right)), np.float32)
    distinct = np.unique(np.concatenate([m[2] for m in one]))
    vocabulary = distinct if one is right else np.intersect1d(distinct, np.concatenate([m[2] for m in right]))
    if not len(vocabulary):
        return out
    sides = _side(one, vocabulary), _side(right, vocabulary)
    times = [np.bincount(columns, minlength=len(vocabulary)) for _, columns in sides]
    dense = times[0] * times[1] >= max(out.size * DENSE, 1)
    dense &= times[0] + times[1] > 2 * (one is right)  # a value of one set alone is no pair's
    matrices = []
    for side, (rows, columns) in zip((one, right), sides):
        place = np.cumsum(dense) - 1
        matrix = np.zeros((len(side), int(dense.sum())), np.float32)
        matrix[rows[dense[columns]], place[columns[dense[columns]]]] = 1
        matrices.append(matrix)
    out += matrices[0] @ matrices[1].T
    # The others: each row of the left side with the rows of the right side that hold its value.
    (rows, columns), (others, _) = sides
    few = np.flatnonzero(~dense[columns])
    rows, columns = rows[few], columns[few]
    first, many = (np.cumsum(times[1]) - times[1])[columns], times[1][columns]
    ends = np.cumsum(many)
    flat, at = out.reshape(-1), 0
    while at < len(rows):
        to = max(int(np.searchsorted(ends, ends[at] - many[at] + PAIRS, "right")), at + 1)
        n = many[at:to]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cells, counts = np.unique(np.repeat(rows[at:to], n) * len(right) + others[np.repeat(first[at:to], n) + within], return_counts=True)
        flat[cells] += counts
        at = to
    return out


def _block_links(one: list[tuple], other: list[tuple] | None, p: Sketching) -> list[tuple[int, int]]:
    """Links between two blocks of (rep, component, set), or inside one: as many as join all components that links join."""
    right = one if other is None else other
    common = _common(one, right)
    n, r = np.array([len(m[2]) for m in one])[:, None], np.array([len(m[2]) for m in right])[None, :]
    linked = common * 100 >= (n + r - common) * p.percent
    linked &= np.array([m[1] for m in one])[:, None] != np.array([m[1] for m in right])[None, :]
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            above[x] = x = above.get(above[x], above[x])
        return x

    found = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1) if other is None else linked)):
        a, b = top(one[i][1]), top(right[j][1])
        if a != b:
            above[a] = b
            found.append((one[i][0], right[j][0]))
    return found


def _met_in_blocks(members: DataFrame, p: Sketching) -> DataFrame:
    """Links (u, v) inside each clump between members (clump, rep, n, component, set) of different components.

    A clump is dealt into bands of set size, in which neighbours at most can be linked, and each band into
    parts of about ``block`` rows or ``block_values`` values; two parts meet in one group of rows. Rows grow by the
    number of parts.
    """
    band = F.floor(F.log("n") / float(np.log(100 / p.percent))).cast("int")
    dealt = members.withColumn("band", band)
    parts = F.greatest(F.ceil(F.count("*") / p.block), F.ceil(F.sum("n") / p.block_values))
    sizes = dealt.groupBy("clump", "band").agg(parts.cast("int").alias("parts"))
    dealt = dealt.join(sizes, ["clump", "band"]).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    for name, shift in (("below", -1), ("above", 1)):
        near = sizes.select("clump", (F.col("band") - shift).alias("band"), F.col("parts").alias(name))
        dealt = dealt.join(near, ["clump", "band"], "left")
    cell = lambda b, q: F.struct(b.alias("band"), q.alias("part"))

    def cells(column: str, shift: int):
        count = F.coalesce(F.col(column), F.lit(0))
        parts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(parts, lambda q: cell(F.col("band") + shift, q))

    other = F.explode(F.concat(cells("parts", 0), cells("below", -1), cells("above", 1)))
    own = cell(F.col("band"), F.col("part"))
    met = dealt.withColumn("other", other).select(
        "clump", F.least(own, "other").alias("a"), F.greatest(own, "other").alias("b"), (own == F.least(own, "other")).alias("first"), "rep", "component", "set"
    )
    keys = [F.col("clump"), F.col("a"), F.col("b")]
    met = met.select(F.xxhash64(*keys).alias("cell"), (F.col("a") == F.col("b")).alias("same"), "first", "rep", "component", "set")
    met = met.repartition("cell").sortWithinPartitions("cell")

    def make():
        held: dict = {"cell": None, "rows": []}

        def links(rows: list) -> list[tuple[int, int]]:
            if rows and rows[0][0]:
                return _block_links([r[2:] for r in rows], None, p)
            one, other = [r[2:] for r in rows if r[1]], [r[2:] for r in rows if not r[1]]
            return _block_links(one, other, p) if one and other else []

        def out(found: list[tuple[int, int]]):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

        def one(batch: pa.RecordBatch):
            plain = [batch.column(c).to_pylist() for c in ("cell", "same", "first", "rep", "component")]
            offsets, values = batch.column("set").offsets.to_numpy(), batch.column("set").values.to_numpy()
            for i, (cell_, same, first, rep, component) in enumerate(zip(*plain)):
                if cell_ != held["cell"]:
                    yield from out(links(held["rows"]))
                    held["cell"], held["rows"] = cell_, []
                held["rows"].append((same, first, rep, component, values[offsets[i] : offsets[i + 1]].copy()))

        def rest():
            yield from out(links(held["rows"]))

        one.rest = rest
        return one

    return map_batches(met, "u long, v long", make)


def near_duplicates(docs: DataFrame, params: Sketching = Sketching()) -> DataFrame:
    """Groups of near-duplicates: one row (doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Two documents are linked when the Jaccard similarity of their shingle sets reaches the limit;
    ``component_id`` is the smallest doc_id reachable by links and ``kept`` tells whether the row
    has it. Words are runs without ASCII white space, A-Z lower-cased, over the whole text.

    Null or wordless texts have no shingles and are linked with nothing. A row without doc_id has
    no component and is kept. Rows that share a doc_id share its component if their texts are linked,
    else each stands for its own text. An empty table gives no rows; other columns are not read.
    """
    p = params
    marked = written(_sketch_documents(docs, p), "sketches")
    named = marked.where("doc_id is not null and n_shingles > 0")
    classes = written(
        named.groupBy("d1", "d2", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
        .select("rep", F.col("n_shingles").alias("n"), "d1", "d2", "sketch"),
        "classes",
    )
    postings = written(_postings(classes, p), "postings")
    lists = (
        postings.groupBy("value")
        .agg(F.count("*").alias("members"), F.min("rep").alias("centre"), F.max("rep").alias("other_centre"))
        .where("members > 1")
    )
    listed = written(postings.join(lists, "value"), "listed")

    # Long lists: every member with the first or last one of most of its lists. A class has a bounded number of lists.
    size = classes.select(F.col("rep").alias("centre"), F.col("n").alias("centre_n"))
    most_lists = Window.partitionBy("rep").orderBy(F.desc("times"), "centre")
    starred = (
        listed.where(F.col("members") > p.long_list)
        .select("rep", "n", F.explode(F.array("centre", "other_centre")).alias("centre"))
        .where("rep <> centre")
        .groupBy("rep", "n", "centre")
        .agg(F.count("*").alias("times"))
        .withColumn("place", F.row_number().over(most_lists))
        .where(F.col("place") <= p.centres)
        .join(size, "centre")
        .where(_sizes_fit(F.col("n"), F.col("centre_n"), p.percent))
        .select(F.col("centre").alias("a"), F.col("rep").alias("b"))
    )
    starred = written(starred, "starred")
    first = written(_verified(written(_estimated(starred, classes, p), "estimated"), docs, p), "links")
    groups = components(first)

    label = groups.select(F.col("node").alias("rep"), "component")
    whole = listed.select("value", "members", "centre", "rep", "n").join(label, "rep", "left")
    whole = written(whole.withColumn("component", F.coalesce("component", "rep")), "labelled")

    # Long lists whose members are still apart: the members' full sets are listed.
    many, few = F.col("members") > p.long_list, F.col("members") <= p.long_list
    apart = whole.where(many).groupBy("value").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("value")
    members = written(whole.where(many).join(apart, "value", "left_semi").select("rep", "component").distinct(), "members")
    sets = _full_sets(docs, members, p).join(members, "rep").select("rep", F.size("set").cast("long").alias("n"), "component", "set")
    sets = written(sets.dropDuplicates(["rep", "n"]), "sets")
    rarest = written(_rarest(sets, p), "rarest")
    lists = (
        rarest.groupBy("value")
        .agg(F.count("*").alias("members"), F.min("rep").alias("centre"), F.min("component").alias("a"), F.max("component").alias("b"))
        .where("a < b")
    )
    rarest = written(rarest.join(lists.select("value", "members", "centre"), "value"), "rarest_listed")
    # Where these are long too, everything that they hold together is a clump.
    long = rarest.where(many)
    clumps = components(long.select(F.col("rep").alias("u"), F.col("centre").alias("v")).distinct())
    clumped = long.select("rep", "n").distinct().join(clumps.select(F.col("node").alias("rep"), F.col("component").alias("clump")), "rep")
    second = written(_met_in_blocks(written(sets.join(clumped, ["rep", "n"]), "clumped"), p), "links")

    # Short lists: their members in pairs. Of the rarest values of full sets, one in common is enough.
    def pairs(short: DataFrame, least: Column) -> DataFrame:
        x, y = short.alias("x"), short.alias("y")
        return (
            x.join(y, F.col("x.value") == F.col("y.value"))
            .where("x.rep < y.rep and x.component <> y.component")
            .where(_sizes_fit(F.col("x.n"), F.col("y.n"), p.percent))
            .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.least("x.n", "y.n").alias("n"))
            .groupBy("a", "b", "n")
            .agg(F.count("*").alias("times"))
            .where(least)
            .select("a", "b")
        )

    met = pairs(whole.where(few), (F.col("times") >= p.shared) | (F.col("n") < 32)).union(pairs(rarest.where(few), F.lit(True))).distinct()
    third = written(_verified(written(_estimated(written(met, "met"), classes, p), "estimated"), docs, p), "links")
    groups = components(first.union(second).union(third))
    found = classes.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "d1", "d2", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component")
    )
    return (
        marked.drop("sketch")
        .join(found, ["d1", "d2", "n_shingles"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias(
                "component_id"
            ),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
