"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words.  Each source's target is its share, by weight, of ``share`` times all sizes, at most
``cap`` times its own size, the excess reshared by weight (water filling).

A source's documents are permuted by a keyed hash and its top bits cut the permutation into blocks.
The mix takes whole passes over a source, then the blocks at the front of one more, and inside the
one block where the target falls the documents at its front; so every document is taken ``passes`` or
``passes + 1`` times and a source misses its target by less than a document.  The place of the cut is
found by three levels of histograms, ``BINS`` bins each, never by sorting a source: only documents in
one of ``BINS ** 3`` bins are ranked together.

Blocks are the unit in which shards get their parts.  A binary tree over the output shards splits the
exact quotas: at each node the left half's blocks of each source are a multivariate hypergeometric
draw from the node's, so every shard gets the same number of blocks, up to one, and the shards' mixes
vary only as drawing without replacement does.  A source's draws, numbered pass by pass in the
permuted order, go to the shards in turn by these counts, which are disjoint ranges, so each document
row has a shard for each of its copies; inside its shard a document copy has a random sort key.
Every draw is a function of the seed, so reruns agree.

Null texts have size 0; very long ones are counted whole.  A document of size 0 is taken with the
blocks before the cut.  The null source comes last.  A document's place follows from its id and text,
null or not.  Repeated rows count each: rows of one place and size are ranked as one group, and which of
them are taken follows from where they are stored, in runs, so no group meets in one task.  Sources of
no words, and empty tables, have target 0 and nothing is taken.  Sources are a catalogue: one row each
is held by the driver, up to ``SOURCES``, beyond which it is an error.  Extra columns, whatever their names,
stay out of the plan; ``mixed_documents`` carries them along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables
from .textcore import word_counts

# Fixed values of the mix.
WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0

BITS = 10
BINS = 1 << BITS
SHARDS = 32
#: Sources that the driver holds at most, with their blocks by shard about 400 bytes each.
SOURCES = 500_000
SEED = 20240607


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(word_counts(batch.column(2))), *batch.columns[3:]], ["doc_id", "source", "size", *batch.schema.names[3:]])


def _measured(rows: DataFrame) -> DataFrame:
    """Rows of doc_id, source, text and others, with the text's size in its place."""
    return rows.mapInArrow(_sizes, T.StructType([*rows.schema.fields[:2], T.StructField("size", T.LongType()), *rows.schema.fields[3:]]))


def _placed(documents: DataFrame, seed: int, *others) -> DataFrame:
    key = F.xxhash64("doc_id", "text", F.lit(seed))
    rows = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"), *others)
    return rows.withColumn("place", F.shiftrightunsigned(key, 4))


def sized(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size and the document's place in its source's permutation, 0 to 2**60."""
    return _measured(_placed(documents, seed))


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Target words of each source; ``sizes`` in any order."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = share * sum(size.values()), list(size), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > cap * size[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = cap * size[s]
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def split(quota: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows), by the splitting tree."""
    out = np.zeros((shards, len(quota)), np.int64)
    total = int(quota.sum())
    room = np.full(shards, total // shards) + (np.arange(shards) < total % shards)
    stack = [(0, shards, quota.astype(np.int64))]
    while stack:
        a, b, own = stack.pop()
        if b - a == 1:
            out[a] = own
            continue
        middle = (a + b) // 2
        draw = np.random.Generator(np.random.PCG64([seed, a, b]))
        left = draw.multivariate_hypergeometric(own, int(room[a:middle].sum()), method="marginals") if own.sum() else own
        stack += [(a, middle, left), (middle, b, own - left)]
    return out


def _bin(level: int):
    return F.shiftright("place", 60 - BITS * (level + 1)).bitwiseAND(F.lit(BINS - 1)).cast("int")


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def _dealt(docs: DataFrame, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sources, draws) of stored sizes: each source's target and cut with its shards' ranges of draws,
    and these ranges as rows (source, shard, low, high)."""
    spark = docs.sparkSession
    rows = docs.groupBy("source").agg(F.sum("size").alias("n")).limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    goal = targets([(r["source"], r["n"]) for r in rows])
    size = {r["source"]: r["n"] for r in rows}
    whole = {s: int(goal[s] // size[s]) if size[s] else 0 for s in goal}
    rest = {s: max(0.0, goal[s] - whole[s] * size[s]) for s in goal}
    schema = "source string, source_size long, target double, whole int, rest double"
    sources = tables.local(spark, [(s, size[s], float(goal[s]), whole[s], rest[s]) for s in goal], schema)

    # the cut: level by level the bin in which the rest falls, and what is left for it
    cut = sources.select("source", "rest")
    bound: list[str] = []
    for level in range(3):
        at = docs.select("source", *(_bin(k).alias(f"b{k}") for k in range(level + 1)), "size").withColumnRenamed("source", "of")
        inside = at.join(cut.select(F.col("source").alias("of_cut"), *bound), F.col("of").eqNullSafe(F.col("of_cut")) & _all([F.col(f"b{k}") == F.col(bound[k]) for k in range(level)]))
        bins = inside.groupBy("of", F.col(f"b{level}").alias("bin")).agg(F.sum("size").alias("n"))
        w = Window.partitionBy("of").orderBy("bin")
        bins = bins.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        joined = bins.join(cut, _same("of", "source"))
        picked = joined.where("before <= rest").groupBy("source", *bound).agg(F.max_by(F.struct(F.col("bin"), (F.col("rest") - F.col("before")).alias("left")), "bin").alias("x"))
        cut = picked.select("source", *bound, F.col("x.bin").alias(f"cut{level}"), F.col("x.left").alias("rest"))
        bound = [*bound, f"cut{level}"]
        cut = tables.stored(cut, "cut")
    cuts = {r["source"]: (sum(r[c] * BINS ** (2 - k) for k, c in enumerate(bound)), r["rest"]) for r in cut.collect()}

    order = sorted(goal, key=lambda s: (s is None, (s or "").encode()))
    quota = np.array([whole[s] * BINS + (cuts[s][0] // BINS**2 if s in cuts else -1) + 1 for s in order], np.int64)
    counts = split(quota, shards, seed)
    ends = np.cumsum(counts, axis=0)
    ranges = {s: [(j, int(ends[j, i] - counts[j, i]), int(ends[j, i])) for j in range(shards) if counts[j, i]] for i, s in enumerate(order)}
    draws = tables.local(spark, [(s, *x) for s in order for x in ranges[s]], "of string, shard int, low long, high long")
    schema = "of string, source_size long, target double, whole int, edge long, inside double, ranges array<struct<shard: int, low: long, high: long>>"
    parts = {s: [{"shard": j, "low": low, "high": high} for j, low, high in ranges[s]] for s in order}
    return tables.local(spark, [(s, size[s], float(goal[s]), whole[s], *cuts.get(s, (None, None)), parts[s]) for s in order], schema), draws


def _assigned(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Placed rows, all they hold carried along, with source_size, target, copies, block and shards.

    Only rows at the cut need their size; those that still have their text are measured there.
    """
    named = rows.join(F.broadcast(sources), _same("source", "of"), "left").drop("of")
    code = sum((_bin(k).cast("long") * F.lit(BINS ** (2 - k)) for k in range(3)), F.lit(0).cast("long"))
    named = named.withColumns({"block": _bin(0), "side": F.coalesce(F.signum((code - F.col("edge")).cast("double")), F.lit(1.0)).cast("int")})
    # documents of the cut's last bin, 2**-30 of a source: the front ones whose middle is before the cut
    edge, rest = named.where("side = 0"), named.where("side <> 0")
    if "size" not in rows.columns:
        edge, rest = _measured(edge), rest.drop("text").withColumn("size", F.lit(None).cast("long"))
    edge = _ranked(tables.stored(edge.withColumn("nth", F.monotonically_increasing_id()), "edge"))
    both = rest.withColumn("extra", (F.col("side") < 0).cast("int")).unionByName(edge).withColumn("copies", F.col("whole") + F.col("extra"))

    def shard(copy):
        draw = copy.cast("long") * BINS + F.col("block")
        return F.filter("ranges", lambda x: (x["low"] <= draw) & (draw < x["high"]))[0]["shard"]

    shards = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies"), F.lit(1)) - 1), shard)).otherwise(F.array().cast("array<int>"))
    return both.withColumn("shards", shards).drop("edge", "inside", "ranges", "side", "extra")


def _ranked(edge: DataFrame) -> DataFrame:
    """Whether each row of the cuts' last bins is taken once more: in the order of places those whose
    middle is before the cut.

    Rows of one place and size are interchangeable and are a group; so many of it are taken, the first
    by ``nth``.  They are numbered in runs of 2**16, so no window holds more than the runs of a group
    or the rows of a run.
    """
    group, run = ["source", "place", "size"], F.shiftright("nth", 16)
    runs = tables.stored(edge.groupBy(*group, run.alias("run")).agg(F.count("*").alias("n"), F.first("inside").alias("inside")), "runs")
    groups = runs.groupBy(*group).agg(F.sum("n").alias("rows"), F.first("inside").alias("inside"))
    ahead = F.sum(F.col("rows") * F.col("size")).over(Window.partitionBy("source").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1))
    fit = F.ceil((F.col("inside") - F.coalesce(ahead, F.lit(0))) / F.col("size") - 0.5)
    groups = groups.withColumn("taken", F.when(F.col("size") == 0, F.when(F.coalesce(ahead, F.lit(0)) < F.col("inside"), F.col("rows")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least(fit, F.col("rows")))))
    keyed = runs.select("source", "place", "size", "run", "n").join(groups.select(*(F.col(c).alias(f"of {c}") for c in group), "taken"), _all([_same(c, f"of {c}") for c in group]))
    first = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = keyed.select(*(F.col(c).alias(f"of {c}") for c in [*group, "run"]), (F.col("taken") - first).alias("left"))
    rows = edge.withColumn("run", run).join(left, _all([_same(c, f"of {c}") for c in [*group, "run"]])).drop(*(f"of {c}" for c in [*group, "run"]))
    number = F.row_number().over(Window.partitionBy(*group, "run").orderBy("nth"))
    return rows.withColumn("extra", (number <= F.col("left")).cast("int")).drop("nth", "run", "left")


def plan(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, draws): every document row with size, source_size, target, copies, block and the
    shard of each copy, and every source's draws by shard in the order in which its blocks are drawn."""
    docs = tables.stored(sized(documents, seed), "sizes")
    sources, draws = _dealt(docs, shards, seed)
    return _assigned(docs, sources).select("doc_id", "source", "size", "source_size", "target", "copies", "whole", "block", "place", "shards"), draws


def _all(conditions: list):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def mixed(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: a row (doc_id, source, size, copy, shard, sort_key) for each copy taken.

    Written partitioned by shard and sorted by sort_key within, it is the shuffled output.
    """
    planned, _ = plan(documents, shards, seed)
    return _copies(planned, seed, "doc_id", "source", "size").select("doc_id", "source", "size", "copy", "shard", "sort_key")


def _copies(planned: DataFrame, seed: int, *columns: str) -> DataFrame:
    copies = planned.select(*columns, "place", F.posexplode("shards").alias("copy", "shard"))
    return copies.withColumn("sort_key", F.xxhash64("place", "copy", F.lit(seed + 1)))


def mixed_documents(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix as whole rows: each document row as often as it is taken, by shard and, inside it, by sort key.

    A shard is as many partitions as there are shuffle partitions for it, each a range of the sort
    keys; these are evenly spread, so the ranges need no sample.
    """
    sources, _ = _dealt(tables.stored(sized(documents, seed), "sizes"), shards, seed)
    planned = _assigned(_placed(documents, seed, F.struct("*").alias("row")), sources)
    pieces = -(-tables.shuffle_partitions(documents.sparkSession) // shards)
    piece = F.shiftright((F.shiftright("sort_key", 40) + F.lit(1 << 23)) * F.lit(pieces), 24)  # from the key's upper 24 bits
    copies = _copies(planned, seed, "row").repartitionById(shards * pieces, (F.col("shard") * F.lit(pieces) + piece).cast("int"))
    return copies.sortWithinPartitions("shard", "sort_key").select("row.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned, _ = plan(tables.read(spark, sf_dir, "documents"))
    dealt = F.size("shards")
    return planned.select("doc_id", "size", "source_size", "target", (dealt * F.col("size")).alias("taken"), dealt.alias("copies"), "block", "shards")
