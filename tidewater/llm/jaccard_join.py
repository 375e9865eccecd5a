"""Near-duplicate documents: an exact join on the Jaccard similarity of 5-word shingle sets.

Shingles are hashed into groups, and the counts of a set in ``DIMS`` groups are a point.  Of two sets
the overlap is at most the sum over the groups of the smaller count; a packed R-tree over the points
gives the same bound for whole boxes, and the pairs that survive are verified on the full sets.

A tree over the whole corpus would compare nearly all pairs, since in so many dimensions every box
overlaps every query.  So points meet in a tree only if their sets agree in a whole group: with
|A ^ B| <= (|A| + |B|) / 9 =: k (which is what a similarity of 0.8 means) at most k of the groups
that A fills can differ from B's.  Each filled group gives an element, the hash of its number and its
contents, and by the prefix principle two linked sets share one of their k + 1 first elements in any
order that is the same for all.  That order is by hash, but elements that many nodes hold come last, so
a passage that many documents share ties none of them that has enough elements of its own.  The number
of groups is fixed per size class, so that groups hold about three shingles; one shared passage
therefore seldom makes two sets agree in a group.

Steps, each over all documents or all that remain open, with no cap on group or candidates:

1. Each text gives its node (the hash of its shingle set, so exact copies are one node).  Elements
   that ``SEEN`` nodes or more of a run of ``RUN`` elements hold are counted, and the ``COMMON`` most
   frequent of all runs come last in the order; which these are decides about work only.  Then each
   text gives its first elements, packed in blocks of about 9 bytes an element, one block per batch
   and partition.
2. Each partition finds the nodes that share an element and ties each to the smallest of them.
   Tied nodes get their points, and ties that the bound rules out are not verified.
3. Each node is verified against the node that it shares most elements with; components follow.
4. Ties that still join two components are verified too; components follow again.
5. Where a tie still joins two components, all nodes tied to the same node meet in R-trees, blocked
   so that no block grows with the group.  Of the pairs of different components that pass the bound
   first the best of each node and component are verified, then, with the components that follow,
   all that are left.  Pairs inside a component need no check, as only the component is asked for.

The groups of a grouped step are as many as its counted input needs, whatever the number of shuffle
partitions, so a task's memory does not follow the corpus.

Sizes, ties, repeated rows: repeated documents, also repeated ids, are rows of the result each.  A
similarity of exactly 0.8 links.  Very long texts are cut in windows and are one set each.
Null and empty texts, and texts without words, have no shingles and are linked with nothing.
Documents without an id link like any other, but name no component; one of only such has a null
component_id.  Extra columns are ignored, whatever their names, and an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import components, tables
from .textcore import U64, distinct_shingles, mix

DIMS = 64
LEAF = 16
#: Nodes of one block of an R-tree group, and members of one verification block.
BLOCK = 4096
STAR = 256
#: Pairs of a node and another component that are verified first.
BEST = 2
#: Frequent elements: nodes of a run that hold one, elements of a run, and how many are known to all tasks (4 MB).
SEEN, RUN, COMMON = 32, 1 << 21, 1 << 19
#: Nodes that a task remembers, so that copies among its rows give their elements once.
REMEMBERED = 10_000
#: What one call of a grouped step gets on average: elements (16 bytes each), and bytes of sets or points.
ELEMENTS, BYTES = 1 << 21, 48 << 20

_CLASS_STARTS = [1]
while _CLASS_STARTS[-1] < 1 << 40:
    _CLASS_STARTS.append(max(_CLASS_STARTS[-1] + 1, _CLASS_STARTS[-1] * 3 // 2))


def size_class(n: int) -> int:
    return bisect_right(_CLASS_STARTS, n) - 1


def groups_of_class(c: int) -> int:
    """Groups for a size class: so many that a set fills more than k of them but for odds below 1e-9."""
    top = _CLASS_STARTS[c + 1] - 1
    return 256 * top if top <= 16 else 16 * top if top <= 64 else top // 3 + 16


def linked(both: int, left: int, right: int) -> bool:
    """Whether sets of these sizes with this overlap have a similarity of 0.8 or more."""
    return 100 * both >= 80 * (left + right - both)


def node_of(s: np.ndarray) -> int:
    """A 63-bit identity of a shingle set."""
    both = np.array([s.sum(dtype=U64), mix(s).sum(dtype=U64)], U64)
    return int(mix(both[:1] * U64(3) + mix(both[1:] + U64(len(s))))[0] >> U64(1)) if len(s) else -1


def all_elements(s: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """For each size class in which a set may meet a partner its elements, and how many of them may differ."""
    n, out = len(s), []
    contents = mix(s ^ U64(0xA5A5A5A5A5A5A5A5))
    high = s >> U64(32)
    own = size_class(n)
    for c in range(size_class(-(-4 * n // 5)), own + 1):
        group = (high * U64(groups_of_class(c))) >> U64(32)
        starts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
        out.append((np.add.reduceat(contents, starts) ^ mix(group[starts] + U64(c << 48)), (n + n * 5 // 4) // 9 if c == own else 2 * n // 9))
    return [(mix(e), k) for e, k in out]


def is_common(e: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which elements are among the sorted frequent ones."""
    if not len(common):
        return np.zeros(len(e), dtype=bool)
    return common[np.minimum(np.searchsorted(common, e), len(common) - 1)] == e


def elements(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The elements by which a set meets its possible partners: the first of each class, frequent ones last."""
    out = []
    for e, k in all_elements(s):
        if len(e) > k + 1:
            last = is_common(e, common)
            rare, rest = e[~last], e[last]
            e = _smallest(rare, k + 1) if len(rare) > k else np.concatenate([rare, _smallest(rest, k + 1 - len(rare))])
        out.append(e)
    return np.concatenate(out)


def _smallest(e: np.ndarray, n: int) -> np.ndarray:
    return np.partition(e, n - 1)[:n] if len(e) > n else e


def point(s: np.ndarray) -> np.ndarray:
    """Counts of a set in a power of two of groups, as many as it has shingles and DIMS at least.

    In so many groups the bound is nearly the overlap itself.
    """
    dims = max(DIMS, 1 << max(0, (len(s) - 1).bit_length()))
    return np.bincount((s & U64(dims - 1)).astype(np.int64), minlength=dims)


def packed_point(s: np.ndarray) -> bytes:
    """A point in one byte a group, or two if a count needs it, after a byte that says which."""
    counts = point(s)
    return b"\1" + counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"\2" + counts.astype("<u2").tobytes()


def unpacked_point(raw: bytes) -> np.ndarray:
    """A view of the bytes; sums over it widen by themselves."""
    return np.frombuffer(raw, np.uint8 if raw[0] == 1 else "<u2", offset=1)


def may_be_linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The bound by summed minima, in as many groups as both points have."""
    least = min(len(a), len(b))
    return 9 * int(np.minimum(folded(a, least), folded(b, least)).sum()) >= 4 * (int(a.sum()) + int(b.sum()))


def folded(points: np.ndarray, dims: int) -> np.ndarray:
    """The same counts in fewer groups."""
    return points.reshape(*points.shape[:-1], -1, dims).sum(-2, dtype=np.int32) if points.shape[-1] > dims else points


# -- step 1 and 2: nodes, elements, ties ---------------------------------------------------------

NODES = "doc_id long, n_shingles long, node long, handle long, holders long"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text; and for frequent elements of a run one with the element as node, and its holders."""
    names = [f.split()[0] for f in NODES.split(", ")]
    seen: set[int] = set()
    run, held = [], 0
    for batch in batches:
        n, node = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, -1, np.int64)
        for row, s in distinct_shingles(batch.column(1)):
            n[row], node[row] = len(s), node_of(s)
            if len(s) and _fresh(int(node[row]), seen):
                run += [e for e, _ in all_elements(s)]
                held += len(s)
                if held >= RUN:
                    yield from _frequent(run, names)
                    run, held = [], 0
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(node), batch.column(2), pa.nulls(batch.num_rows, pa.int64())], names)
    yield from _frequent(run, names)


def _fresh(node: int, seen: set[int]) -> bool:
    """Whether a node is not among the last ones seen; whether it is decides about work only."""
    if node in seen:
        return False
    if len(seen) >= REMEMBERED:
        seen.clear()
    seen.add(node)
    return True


def _frequent(run: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    if run:
        e = np.sort(np.concatenate(run))
        ends = np.flatnonzero(np.concatenate([e[1:] != e[:-1], [True]]))
        count = np.diff(ends, prepend=-1)
        often = count >= SEEN
        if often.any():
            none = pa.nulls(int(often.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(e[ends[often]].view(np.int64)), none, pa.array(count[often])], names)


def _packed(parts: int, common):
    """Elements of each batch as one block of bytes for each partition that gets any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found, owners = [], []
            for _, s in distinct_shingles(batch.column(0)):
                if len(s) and _fresh(node := node_of(s), seen):
                    found.append(elements(s, common.value))
                    owners.append(node)
            if not found:
                continue
            counts = np.array([len(x) for x in found])
            e, at = np.concatenate(found), np.repeat(np.arange(len(found)), counts)
            owner = np.array(owners, np.int64)
            part = ((e >> U64(20)) & U64(0xFFFFFFFF)) * U64(parts) >> U64(32)
            order = np.argsort(part.astype(np.int64) * len(found) + at, kind="stable")
            e, at, part = e[order], at[order], part[order]
            cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                heads = np.concatenate([[0], np.flatnonzero(at[a + 1 : b] != at[a : b - 1]) + 1, [b - a]])
                rows.append((int(part[a]), e[a:b].tobytes(), owner[at[a:b][heads[:-1]]].tobytes(), np.diff(heads).astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "elements", "nodes", "counts"])

    return run


def _ties(table: pa.Table) -> pa.Table:
    """For nodes that share an element: each with the smallest of them, and how many they share."""
    e = np.concatenate([np.frombuffer(x, U64) for x in table["elements"].to_pylist()])
    node = np.concatenate([np.repeat(np.frombuffer(x, np.int64), np.frombuffer(k, np.uint32)) for x, k in zip(table["nodes"].to_pylist(), table["counts"].to_pylist(), strict=True)])
    order = np.argsort(e)
    e, node = e[order], node[order]
    same = e[1:] == e[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    e, node = e[shared], node[shared]
    if not len(e):
        return _TIES.empty_table()
    order = np.lexsort((node, e))
    e, node = e[order], node[order]
    fresh = np.concatenate([[True], (e[1:] != e[:-1]) | (node[1:] != node[:-1])])
    e, node = e[fresh], node[fresh]
    heads = np.concatenate([[True], e[1:] != e[:-1]])
    first = node[np.flatnonzero(heads)[np.cumsum(heads) - 1]]
    pairs, count = np.unique(np.stack([node, first])[:, node != first], axis=1, return_counts=True) if (node != first).any() else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
    return pa.table([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(count.astype(np.int64))], schema=_TIES)


_TIES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64())])


# -- verification --------------------------------------------------------------------------------


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each wanted node's set as bytes, once for each block that it belongs to."""
    schema = pa.schema([("block", pa.int64()), ("node", pa.int64()), ("center", pa.bool_()), ("members", pa.binary())])
    for batch in batches:
        blocks, wanted = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        rows, held = [], 0
        for row, s in distinct_shingles(batch.column(0)):
            node, raw = node_of(s), s.tobytes()
            if node != wanted[row]:
                continue
            for x in blocks[row]:
                rows.append((x["block"], node, x["center"], raw))
                held += len(raw)
            if held > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verified(table: pa.Table) -> pa.Table:
    """In each block, the members whose full set is linked with the centre's."""
    by: dict[int, list[int]] = defaultdict(list)
    centers: dict[int, int] = {}
    block, node, is_center = table["block"].to_numpy(), table["node"].to_numpy(), table["center"].to_numpy(zero_copy_only=False)
    members = table["members"].combine_chunks() if table["members"].num_chunks != 1 else table["members"].chunk(0)
    for i, (g, c) in enumerate(zip(block.tolist(), is_center.tolist(), strict=True)):
        if c:
            centers[g] = i
        else:
            by[g].append(i)
    out = []
    for g, rows in by.items():
        if (c := centers.get(g)) is None:
            continue
        center = np.frombuffer(members[c].as_buffer(), U64)
        for i in dict.fromkeys(rows):
            own = np.frombuffer(members[i].as_buffer(), U64)
            if linked(overlap(own, center), len(own), len(center)):
                out.append((int(node[i]), int(node[c])))
    return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], schema=_EDGES)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _parts(spark: SparkSession, total: int | float | None, each: int) -> int:
    """Groups for so much input: as many as there are shuffle partitions, or so many that none gets more than ``each``."""
    return max(tables.shuffle_partitions(spark), -(-int(total or 0) // each))


def _verify(documents: DataFrame, names: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (a, b) that are linked.  Pairs meet at b, in blocks of about STAR members."""
    spark = documents.sparkSession
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(STAR)).cast("int").alias("salts"))
    salted = pairs.join(sizes, "b")
    members = salted.select(F.col("a").alias("node"), F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("salts"))).alias("block"), F.lit(False).alias("center"))
    centers = sizes.select(F.col("b").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "b").select("node", F.xxhash64("b", F.col("salt").cast("long")).alias("block"), F.lit(True).alias("center"))
    wanted = members.unionByName(centers).groupBy("node").agg(F.collect_set(F.struct("block", "center")).alias("blocks"))
    wanted = tables.stored(wanted.join(names, "node").select("doc_id", "handle", "node", "n_shingles", "blocks"), "wanted")
    parts = _parts(spark, wanted.agg(F.sum(F.size("blocks") * F.col("n_shingles") * 8)).first()[0], BYTES)
    blocks = _joined(documents, wanted.drop("n_shingles")).select("text", "blocks", "node").mapInArrow(_sets, "block long, node long, center boolean, members binary")
    found = blocks.withColumn("part", F.pmod("block", F.lit(parts)).cast("int")).groupBy("part").applyInArrow(_verified, "a long, b long")
    return tables.stored(found.distinct(), "links")


def _joined(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents that ``wanted`` names by id and by a hash of the text, a row for each node.

    Broadcast only below a size that is checked.  Texts without an id are found by the hash, one of
    equal ones.
    """
    small = wanted.agg(F.count("*"), F.sum(F.size("blocks")), F.count_if(F.col("doc_id").isNull())).first()
    fits = small[0] <= tables.BROADCAST_ROWS and (small[1] or 0) <= tables.BROADCAST_ROWS
    of = F.broadcast if fits else lambda x: x
    out = documents.where("doc_id is not null").join(of(wanted.where("doc_id is not null")), ["doc_id", "handle"])
    if small[2]:
        unnamed = documents.where("doc_id is null").join(of(wanted.where("doc_id is null").drop("doc_id")), "handle").dropDuplicates(["node"])
        out = out.unionByName(unnamed.select(*out.columns))
    return out


# -- step 5: R-trees -----------------------------------------------------------------------------


class CountRTree:
    """A packed R-tree over count vectors: sorted by size, then by the fullest coordinates."""

    def __init__(self, points: np.ndarray):
        self.size = points.sum(1)
        spread = np.argsort(-points.std(0))[:2] if len(points) else np.array([0, 1])
        self.order = np.lexsort((points[:, spread[1]], points[:, spread[0]], self.size))
        self.points = points[self.order]
        high, low_n, high_n = self.points, self.size[self.order], self.size[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # from the leaves' boxes up
        while len(high) > 1 or not self.levels:
            heads = np.arange(0, len(high), LEAF)
            high, low_n, high_n = np.maximum.reduceat(high, heads), np.minimum.reduceat(low_n, heads), np.maximum.reduceat(high_n, heads)
            self.levels.append((high, low_n, high_n))

    def search(self, q: np.ndarray) -> np.ndarray:
        """Positions of points that may be linked with ``q``: no box or point is left out that could be."""
        n = int(q.sum())
        boxes = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            high, low_n, high_n = self.levels[k]
            bound = np.minimum(high[boxes], q).sum(1)
            keep = (9 * bound >= 4 * (n + np.maximum(low_n[boxes], 1))) & (5 * high_n[boxes] >= 4 * n) & (4 * low_n[boxes] <= 5 * n)
            below = len(self.levels[k - 1][0]) if k else len(self.points)
            boxes = (boxes[keep][:, None] * LEAF + np.arange(LEAF)).ravel()
            boxes = boxes[boxes < below]
        found = self.points[boxes]
        keep = 9 * np.minimum(found, q).sum(1) >= 4 * (n + found.sum(1))
        return self.order[boxes[keep]]


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wanted = batch.column(1).to_pylist()
        rows = [(wanted[row], packed_point(s)) for row, s in distinct_shingles(batch.column(0)) if len(s) and node_of(s) == wanted[row]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["node", "counts"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [may_be_linked(unpacked_point(x), unpacked_point(y)) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        yield batch.select([0, 1, 2]).filter(pa.array(keep, pa.bool_()))


def _possible(ties: DataFrame, points: DataFrame) -> DataFrame:
    """Ties whose points pass the bound."""
    first = ties.join(points.select(F.col("node").alias("a"), F.col("counts").alias("ca")), "a")
    both = first.join(points.select(F.col("node").alias("b"), F.col("counts").alias("cb")), "b")
    return tables.stored(both.select("a", "b", "shared", "ca", "cb").mapInArrow(_bounded, "a long, b long, shared long"), "possible")


def _tree_pairs(best: int | None):
    """Pairs of different components that pass the bound, of the queries and points of each block.

    ``best``: keep so many pairs of a query and another component, those with the highest bound.
    """

    def run(table: pa.Table) -> pa.Table:
        out: set[tuple[int, int]] = set()
        block, node, label, role = (table[c].to_numpy() for c in ("block", "node", "label", "role"))
        fine = [unpacked_point(x) for x in table["counts"].to_pylist()]
        counts = np.stack([folded(x, DIMS) for x in fine]).astype(np.int32)
        dims, size = np.array([len(x) for x in fine]), counts.sum(1, dtype=np.int64)
        order = np.argsort(block, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block[order])) + 1, [len(block)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[a:b]
            members, queries = rows[role[rows] != QUERY], rows[role[rows] != MEMBER]
            if not len(members) or not len(queries):
                continue
            tree = CountRTree(counts[members])
            for i in queries:
                near = members[tree.search(counts[i])]
                near = near[label[near] != label[i]]
                bounds = np.zeros(len(near), np.int64)
                for d in np.unique(dims[near]).tolist():
                    at, least = np.flatnonzero(dims[near] == d), min(d, int(dims[i]))
                    q = folded(fine[i], least)
                    for k in range(0, len(at), 256):
                        some = at[k : k + 256]
                        bounds[some] = np.minimum(folded(np.stack([fine[j] for j in near[some]]), least), q).sum(1, dtype=np.int64)
                passed = 9 * bounds >= 4 * (size[i] + size[near])
                near, bounds = near[passed], bounds[passed] / (size[i] + size[near[passed]])
                if best is not None and len(near) > best:
                    by = np.lexsort((node[near], -bounds, label[near]))
                    heads = np.flatnonzero(np.concatenate([[True], np.diff(label[near][by]) != 0]))
                    rank = np.arange(len(by)) - np.repeat(heads, np.diff(np.append(heads, len(by))))
                    near = near[by[rank < best]]
                out |= {(max(int(node[i]), j), min(int(node[i]), j)) for j in node[near].tolist()}
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], schema=_EDGES)

    return run


#: Parts of a row in an R-tree block.
MEMBER, QUERY, BOTH = 0, 1, 2


def _open_pairs(ties: DataFrame, points: DataFrame, labels: DataFrame, best: int | None) -> DataFrame | None:
    """Pairs still to be verified: those of nodes tied to one node, of different components."""
    unresolved = tables.stored(_labelled(ties, labels).where("la <> lb").select("a", "b"), "open")
    if unresolved.isEmpty():
        return None
    asks = unresolved.select("b", F.col("a").alias("node"), F.lit(1).alias("asks"))
    centers = unresolved.select("b", F.col("b").alias("node"), F.lit(0).alias("asks")).distinct()
    tied = ties.join(unresolved.select("b").distinct(), "b", "left_semi").select("b", F.col("a").alias("node"), F.lit(0).alias("asks"))
    groups = tied.unionByName(asks).unionByName(centers).groupBy("b", "node").agg(F.max("asks").alias("asks"))
    groups = tables.stored(groups, "groups")
    parts = _parts(ties.sparkSession, groups.count() * float(points.agg(F.avg(F.octet_length("counts"))).first()[0] or 0), BYTES)
    sizes = groups.groupBy("b").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("salts"))
    dealt = groups.join(sizes, "b").withColumn("own", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    salts = F.when(F.col("asks") == 1, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array("own"))
    role = F.when(F.col("asks") == 0, MEMBER).when(F.col("salt") == F.col("own"), BOTH).otherwise(QUERY)
    rows = dealt.withColumn("salt", F.explode(salts)).select("node", F.xxhash64("b", F.col("salt").cast("long")).alias("block"), role.alias("role"))
    rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(points, "node")
    pairs = rows.withColumn("part", F.pmod("block", F.lit(parts)).cast("int")).select("part", "block", "node", "label", "role", "counts").groupBy("part").applyInArrow(_tree_pairs(best), "a long, b long")
    return tables.stored(pairs.distinct(), "pairs")


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return pairs.join(la, "a", "left").join(lb, "b", "left").withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")})


# -- the operator --------------------------------------------------------------------------------


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, node (identity of the shingle set), handle (hash of the text)
    and label (identity of the component, null without shingles) of every document row."""
    spark: SparkSession = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("handle", F.xxhash64("text"))
    seen = tables.stored(documents.mapInArrow(_nodes, NODES), "nodes")
    nodes = seen.where("holders is null").drop("holders")
    often = seen.where("holders is not null").groupBy("node").agg(F.sum("holders").alias("holders")).orderBy(F.desc("holders"), "node").limit(COMMON).select("node")
    common = spark.sparkContext.broadcast(np.sort(often.toArrow()["node"].to_numpy().view(U64)))
    named = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "handle")
    names = tables.stored(nodes.where("node >= 0").groupBy("node", "n_shingles").agg(F.min(named).alias("x")).select("node", "n_shingles", "x.doc_id", "x.handle"), "names")
    # a set of n shingles gives at most 2n / 9 + 1 elements in each of two or three size classes
    parts = _parts(spark, names.agg(F.sum(F.col("n_shingles") * 0.5 + 3)).first()[0], ELEMENTS)
    packed = documents.select("text").mapInArrow(_packed(parts, common), "part int, elements binary, nodes binary, counts binary")
    ties = tables.stored(packed.groupBy("part").applyInArrow(_ties, "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared")), "ties")
    tied = ties.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = tables.stored(tied.join(names, "node").select("doc_id", "handle", "node"), "tied").withColumn("blocks", F.array(F.lit(0)))
    points = tables.stored(_joined(documents, wanted).select("text", "node").mapInArrow(_points, "node long, counts binary").dropDuplicates(["node"]), "points")
    possible = _possible(ties, points)
    best = possible.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"))
    links = _verify(documents, names, best)
    labels = tables.stored(components.connected(links), "labels")
    for step in (0, 1, 2):
        if step == 0:
            pairs = tables.stored(_labelled(possible, labels).where("la <> lb").select("a", "b"), "rest")
        else:
            pairs = _open_pairs(ties, points, labels, BEST if step == 1 else None)
        if pairs is not None and not pairs.isEmpty():
            links = tables.stored(links.unionByName(_verify(documents, names, pairs)), "all")
            labels = tables.stored(components.connected(links), "labels")
    # a node outside all links is its own component, named by its smallest document
    least = labels.join(names, "node").groupBy("label").agg(F.min("doc_id").alias("least"))
    of_node = names.join(labels, "node", "left").join(least, "label", "left").select("node", F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("label", "node").alias("label"))
    whole = nodes.where("node >= 0").join(of_node, "node", "left").select("doc_id", "n_shingles", "component_id", "node", "handle", "label")
    bare = nodes.where("node < 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "node", "handle", F.lit(None).cast("long").alias("label"))
    return whole.unionByName(bare)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(tables.read(spark, sf_dir, "documents")).drop("node", "handle", "label")
