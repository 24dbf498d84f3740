"""Exact Jaccard join of documents by their sets of word shingles, as a metric-space join.

A link is a Jaccard distance of at most 1/4. Sets that link share one of their rarest shingles, as many as a partner can't all miss (a cell).
Unrelated documents are at distance 1 from everything, so pivots are drawn where sets meet:

1. The most central set of each cell (the one that meets most others, over all its cells) is a pivot; the sets of the cells that it leads
   are its region. Two sets that link stand together in the region of each cell that they share, so no pair crosses regions.
2. A region of more than REGION sets is split: PIVOTS pivots of its own are drawn, and every set is measured to each of them. It goes to the
   Voronoi region of the nearest, and is replicated to those of others at most 2 * 1/4 farther, which a partner can have as its nearest. The new
   regions join recursively, by pivots and distances of their own. Sets at 3/4 or more from all pivots are a region too: a partner may be at distance 1 from all.
3. A region that is small enough joins within one task, by the same steps: Voronoi regions and boundary windows down to a few sets,
   where only sets are compared whose distances to the pivot differ by at most 1/4.

Sets at most 1/4 from a pivot are one component with it, and pairs within a component need no comparison; a region that is one component is
finished. Where all distances are alike, so that a split would leave a region nearly whole, the sets outside its
largest component known ask all the others, in blocks of bounded size. Every linked pair is therefore compared or known to be in one component.

Equal sets are one node throughout, so copies cost nothing. Rarity comes from counts of all shingles in a fixed number of
buckets; it only decides an order, which may be any, so its coarseness costs speed and never a link. Sets therefore bring more cells than they
need, and leave those out that turn out to be the largest.

Defined cases: null and empty texts and texts without words have no shingles and link with nothing, nor does a text of its own whose id
is null. Rows with equal ids and equal texts get equal rows. Columns beside id and text aren't read. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm import graph, shared

#: A link: PARTS * intersection >= LEAST * union.
LEAST, PARTS = 75, 100
WORDS = 5
#: The distance of a link, and what is allowed for rounding where distances are compared.
_LINK, _SLACK = 1 - LEAST / PARTS, 1e-9
#: Buckets of the rarity counts: 2 ** 18 numbers, whatever the corpus.
_BITS = 18
#: Sets, and shingles in them, up to which a region joins within one task; pivots of a split; sets of a region that are compared without a split.
REGION, REGION_SHINGLES, PIVOTS, LEAF = 128, 1 << 18, 16, 24
#: One in so many of a set's shingles is spare: its most common cells go, once the sizes of cells are known.
SPARE = 8
#: Stands for the pivot of the sets that are far from all pivots; nodes have numbers from 0.
REST = -1


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _BITS)).astype(np.int64)


def _rarity(docs: DataFrame) -> np.ndarray:
    """Occurrences of shingles by bucket, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _BITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in shared.text_slices(batch.column(0)):
                hashes, _, _, first = shared.words(data, offsets)
                total += np.bincount(_bucket(shared.shingles(hashes, first, WORDS)[0]), minlength=1 << _BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << _BITS, np.int64)
    found = counts.toArrow()  # at most 2 ** _BITS rows
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def _digests(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(shared.mix(s ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def sets_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(place, sorted distinct shingle hashes) of each text of a column."""
    for a, b, data, offsets in shared.text_slices(column):
        hashes, _, _, first = shared.words(data, offsets)
        found, begin = shared.shingles(hashes, first, WORDS)
        for i in range(b - a):
            yield a + i, np.unique(found[begin[i] : begin[i + 1]])


def _prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, n, two digests of the set, and its rarest shingles: as many as a linked partner can't all miss, and n // SPARE more, so that it shares more than n // SPARE of them."""
    rarity = docs.sparkSession.sparkContext.broadcast(_rarity(docs))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = rarity.value
        for batch in batches:
            n, one, two, prefix = [], [], [], []
            for _, s in sets_of(batch.column(1)):
                d = _digests(s)
                n.append(len(s))
                one.append(d[0])
                two.append(d[1])
                prefix.append(s[np.lexsort((s, counts[_bucket(s)]))[: len(s) - -(-LEAST * len(s) // PARTS) + 1 + len(s) // SPARE]].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*prefix, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, one, two)), lists], names=["doc_id", "n", "d1", "d2", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return shared.written(rows.mapInArrow(cut, "doc_id long, n long, d1 long, d2 long, prefix array<long>"), "prefixes")


def _regions(prefixes: DataFrame) -> DataFrame:
    """(region, node) of nodes (node, n, prefix): the members of all cells that a pivot leads, itself included. Cells of one node are none."""
    rows = prefixes.select(F.explode("prefix").alias("cell"), "node", F.expr(f"int(n div {SPARE})").alias("spare"))
    size = F.count("*").over(Window.partitionBy("cell"))
    shared_cells = shared.written(rows.withColumn("size", size).where("size > 1"), "cells")
    # The largest cells that a set can spare go: of those that it shares with a partner, both keep the smallest.
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("size"), F.desc("cell")))
    least = shared_cells.withColumn("rank", rank).where("rank > spare").select("cell", "node")
    cells = shared.written(least.withColumn("size", size).where("size > 1"), "cells")
    shared.discard(shared_cells)
    central = cells.groupBy("node").agg(F.sum(F.col("size") - 1).alias("meets"))
    lead = cells.join(central, "node").groupBy("cell").agg(F.max(F.struct("meets", (-F.col("node")).alias("least"))).alias("x")).select("cell", (-F.col("x.least")).alias("region"))
    found = shared.written(cells.join(lead, "cell").select("region", "node").distinct(), "regions")
    shared.discard(cells)
    return found


def _sets(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """(node, n, shingles) of the nodes wanted (node, head, n, d1, d2), built from the texts of their first documents; rows may be repeated."""
    rows = docs.select(F.col("doc_id").cast("long").alias("head"), F.col("text").cast("string")).join(shared.small(wanted), "head").select("node", "n", "d1", "d2", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two = (batch.column(k).to_numpy() for k in (1, 2, 3))
            # An id may have another text too.
            keep = [(i, s) for i, s in sets_of(batch.column(4)) if len(s) == n[i] and _digests(s) == (one[i], two[i])]
            take = pa.array([i for i, _ in keep], pa.int64())
            offsets = np.concatenate([[0], np.cumsum([len(s) for _, s in keep])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*(s for _, s in keep), np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), lists], names=["node", "n", "shingles"])

    built = rows.mapInArrow(build, "node long, n long, shingles array<long>")
    return shared.written(built.dropDuplicates(["node"]) if repeated else built, "sets")


def voronoi(found: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Who is in the region of each pivot, and how far from it, of distances (pivot, set); and at last in the rest, of those so far from all pivots that a partner may be at distance 1 from all."""
    near = found.min(0)
    regions = [(far <= near + 2 * _LINK + _SLACK) & (far < 1) for far in found]
    return [*regions, near >= 1 - _LINK - _SLACK], [*found, np.zeros(len(near))]


def separates(total, most, size):
    """Whether a split is worth it, by the sizes of its regions (all, largest) and that of the region."""
    return (total <= 2 * size) & (4 * most <= 3 * size)


class Region:
    """Sets that join within a task. Distances come from postings: a set's shingles are looked up, and the sets at each counted."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        _, terms = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self._terms = np.split(terms, np.cumsum(self.sizes)[:-1])
        self._postings = owner[np.argsort(terms, kind="stable")]
        self._begin = np.concatenate([[0], np.cumsum(np.bincount(terms))])
        self.comp = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []

    def common(self, x: int) -> np.ndarray:
        """Shingles that each set shares with set x."""
        terms = self._terms[x]
        count = self._begin[terms + 1] - self._begin[terms]
        take = np.repeat(self._begin[terms] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return np.bincount(self._postings[take], minlength=len(self.sizes))

    def measured(self, x: int, at: np.ndarray) -> np.ndarray:
        """Distances from x to the sets at the places given; those that link join its component."""
        shared_here = self.common(x)[at]
        union = self.sizes[x] + self.sizes[at] - shared_here
        linked = at[PARTS * shared_here >= LEAST * union]
        merged = np.unique(self.comp[linked])
        if len(merged) > 1 or (len(merged) == 1 and merged[0] != self.comp[x]):
            # One link for each component that joins makes a forest of them.
            for c in merged:
                if c != self.comp[x]:
                    self.links.append((x, int(linked[self.comp[linked] == c][0])))
            merged = np.union1d(merged, self.comp[x])
            self.comp[np.isin(self.comp, merged)] = merged[0]
        return 1 - shared_here / union

    def compare(self, at: np.ndarray, asks: np.ndarray, to_pivot: np.ndarray) -> None:
        """Sets that ask are compared with all whose distance to the pivot and size may allow a link."""
        for x, mine in zip(asks, to_pivot[np.searchsorted(at, asks)], strict=True):
            near = (np.abs(to_pivot - mine) <= _LINK + _SLACK) & (self.comp[at] != self.comp[x])
            near &= PARTS * np.minimum(self.sizes[at], self.sizes[x]) >= LEAST * np.maximum(self.sizes[at], self.sizes[x])
            if near.any():
                self.measured(x, at[near])

    def outside(self, at: np.ndarray) -> np.ndarray:
        """Those that aren't in the component that most are in: of two sets in different components, one is."""
        names, count = np.unique(self.comp[at], return_counts=True)
        return at[self.comp[at] != names[count.argmax()]] if len(at) else at

    def join(self, at: np.ndarray, to_pivot: np.ndarray | None = None) -> None:
        """All links among the sets at these (sorted) places, as components."""
        to_pivot = np.zeros(len(at)) if to_pivot is None else to_pivot
        open_ = self.outside(at)
        if not len(open_):
            return
        if len(at) <= LEAF:
            self.compare(at, open_, to_pivot)
            return
        step = max(1, len(open_) // (PIVOTS - 1))
        pivots = np.unique([at[0], *open_[::step][: PIVOTS - 1]])
        found = np.array([self.measured(int(p), at) for p in pivots])
        parts, far = voronoi(found)
        if not separates(sum(map(np.sum, parts)), max(map(np.sum, parts)), len(at)):
            self.compare(at, self.outside(at), to_pivot)
            return
        for inside, own in zip(parts, far, strict=True):
            self.join(at[inside], own[inside])


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of sorted batches by their first columns, which are numbers."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = [batch.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        if held and batch.num_rows:
            change[0] = any(held[-1].column(k)[-1].as_py() != v[0] for k, v in enumerate(values))
        edges = np.flatnonzero(change)
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if change[a : a + 1].any() and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _solved(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect the components among the members (region, part, node, asks, far) of each part of a region. Where asks is null, all meet; else those that ask meet all; far is the distance to a common pivot."""
    rows = members.join(sets.drop("n"), "node").select("region", "part", "node", "asks", "far", "shingles").repartition("region", "part").sortWithinPartitions("region", "part", "node")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, 2):
            node, asks, far = group.column("node").to_numpy(), group.column("asks").to_pylist(), group.column("far").to_numpy()
            once = np.concatenate([[True], node[1:] != node[:-1]])
            lists = group.column("shingles").combine_chunks()
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().view(np.uint64)
            rows_once = np.flatnonzero(once)
            region = Region([flat[at[i] : at[i + 1]] for i in rows_once])
            every = np.arange(len(rows_once))
            if asks[0] is None:
                region.join(every)
            else:
                region.compare(every, np.unique((np.cumsum(once) - 1)[np.array(asks, bool)]), far[rows_once])
            if region.links:
                names = node[rows_once][np.array(region.links)]
                yield pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1])], names=["a", "b"])

    return rows.mapInArrow(solve, "a long, b long")


def _measured(members: DataFrame, sets: DataFrame, n_pivots: int) -> DataFrame:
    """Members (region, node) of large regions, measured to pivots of their own: (region, node, pivot, far, inside, linked), a row for each pivot, and one for the rest."""
    order = Window.partitionBy("region").orderBy(F.xxhash64("region", "node"), "node")
    drawn = members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_pivots)
    pivots = drawn.join(sets.drop("n"), "node").groupBy("region").agg(F.collect_list(F.struct("node", "shingles")).alias("pivots"))
    rows = members.join(sets.drop("n"), "node").join(shared.written(pivots, "pivots"), "region").select("region", "node", "shingles", "pivots")
    names = ["region", "node", "pivot", "far", "inside", "linked"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            region, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(batch.num_rows):
                own, drawn = batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values
                pivots, lists = drawn.field(0).to_numpy(), drawn.field(1)
                common, size = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
                for k in range(len(pivots)):
                    other = lists[k].values.to_numpy()
                    common[k], size[k] = len(np.intersect1d(own, other, assume_unique=True)), len(other)
                union = len(own) + size - common
                inside, far = voronoi((1 - common / union)[:, None])
                for column, values in zip(out, ([region[i]] * len(far), [node[i]] * len(far), [*pivots, REST], [x[0] for x in far], [x[0] for x in inside], [*(PARTS * common >= LEAST * union), False]), strict=True):
                    column += values
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.float64()), *(pa.array(x, pa.bool_()) for x in out[4:])], names=names)

    return shared.written(rows.mapInArrow(measure, "region long, node long, pivot long, far double, inside boolean, linked boolean"), "measured")


def _links(members: DataFrame, sets: DataFrame, limit: int, shingles: int, n_pivots: int) -> DataFrame:
    """Links (a, b) that connect the components among the members (region, node) of all regions."""
    sizes = shared.written(sets.select("node", "n"), "sizes")
    found: list[DataFrame] = []
    fits = f"size <= 2 OR (size <= {limit} AND total <= {shingles})"
    counts = (F.count("*").alias("size"), F.sum("n").alias("total"))
    while True:
        regions = shared.written(members.join(sizes, "node").groupBy("region").agg(*counts), "counts")
        small = members.join(regions.where(fits).select("region"), "region").withColumns({"part": F.lit(0).cast("long"), "asks": F.lit(None).cast("boolean"), "far": F.lit(0.0)})
        found.append(shared.written(_solved(small, sets), "links"))
        large = regions.where(f"NOT ({fits})")
        if large.isEmpty():
            return _together(found)
        measured = _measured(members.join(large.select("region"), "region"), sets, n_pivots)
        found.append(shared.written(measured.where("linked AND node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")), "links"))
        labels = graph.components(_together(found))
        # Pivots have met their whole region, and stay only as the names of the new ones.
        met = measured.where("far = 0 AND node = pivot").select("region", "node")
        named = measured.join(met, ["region", "node"], "left_anti").join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node"))
        parts = shared.written(named.where("inside").select("region", F.xxhash64("region", "pivot").alias("part"), "node", "comp"), "parts")
        state = parts.join(sizes, "node").groupBy("region", "part").agg(*counts, F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").drop("c0", "c1")
        state = shared.written(state, "state")
        # A region that its pivots don't separate isn't split: those outside the component of its most linked pivot ask all, block by block.
        split = state.groupBy("region").agg(F.max("size").alias("most"), F.sum("size").alias("all"))
        whole = split.join(large, "region").where(~separates(F.col("all"), F.col("most"), F.col("size"))).select("region", "size", "total")
        whole = shared.written(whole, "whole")
        rest = state.join(whole.select("region"), "region", "left_anti").select("region", "part")
        if not whole.isEmpty():
            found.append(shared.written(_solved(_blocks(whole, measured, named, labels, limit, shingles), sets), "links"))
        members = shared.written(parts.join(rest, ["region", "part"]).select(F.col("part").alias("region"), "node"), "regions")
        if members.isEmpty():
            return _together(found)


def _blocks(whole: DataFrame, measured: DataFrame, named: DataFrame, labels: DataFrame, limit: int, shingles: int) -> DataFrame:
    """Members (region, part, node, asks, far) of the regions that aren't split, a part for each block of those that ask and block of all."""
    linked = measured.where("linked").groupBy("region", "pivot").agg(F.count("*").alias("n"))
    best = linked.groupBy("region").agg(F.max(F.struct("n", "pivot")).alias("x")).select("region", F.col("x.pivot").alias("pivot"))
    best = whole.join(best, "region").join(labels.select(F.col("node").alias("pivot"), F.col("component").alias("lead")), "pivot", "left").withColumn("lead", F.coalesce("lead", "pivot"))
    rows = named.join(best, ["region", "pivot"]).select("region", "node", "far", (F.col("comp") != F.col("lead")).alias("asks"), "size", "total")
    rows = shared.written(rows, "asking")
    asking = rows.where("asks").groupBy("region").agg(F.count("*").alias("asking"))
    block = max(1, limit // 2)
    count = lambda c: F.greatest(F.ceil(F.col(c) / block), F.ceil(F.col("total") * F.col(c) / F.col("size") * 2 / shingles))
    rows = rows.join(asking, "region").withColumns({"deep": count("asking"), "wide": count("size")})
    rows = rows.withColumns({"i": F.pmod(F.xxhash64("node"), F.col("deep")), "j": F.pmod(F.xxhash64("node"), F.col("wide"))})
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    grid = rows.where("asks").withColumn("j", each("wide")).unionByName(rows.withColumn("i", each("deep")).withColumn("asks", F.lit(False)))
    return grid.select("region", (F.col("i") * F.col("wide") + F.col("j")).alias("part"), "node", "asks", "far")


def _together(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


@shared.tidy
def join(docs: DataFrame, limit: int = REGION, shingles: int = REGION_SHINGLES, n_pivots: int = PIVOTS) -> DataFrame:
    """Per document of a table (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    docs = docs.select("doc_id", "text")
    cut = _prefixes(docs)
    keys = ["d1", "d2", "n"]
    nodes = shared.written(cut.where("n > 0").groupBy(*keys).agg(F.min("doc_id").alias("head")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    own = cut.join(shared.small(nodes.withColumnRenamed("head", "doc_id")), [*keys, "doc_id"]).select("node", "n", "prefix")
    repeated = not cut.groupBy("doc_id", *keys).count().where("count > 1").isEmpty()
    members = _regions(own.dropDuplicates(["node"]) if repeated else own)
    wanted = shared.written(nodes.join(members.select("node").distinct(), "node"), "wanted")
    sets = _sets(docs, wanted, repeated)
    labels = graph.components(_links(members, sets, limit, shingles, n_pivots))
    named = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("head").alias("component_id"))
    groups = shared.written(named.join(least, "component").select(*keys, "component_id"), "groups")
    out = cut.select("doc_id", *keys).join(groups, keys, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
