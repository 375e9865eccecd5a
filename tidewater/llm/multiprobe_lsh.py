"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

Vectors are scaled to length 1, where nearness by cosine is nearness by distance.  Each of ``TABLES``
tables has a few hashes floor((a x + b) / WIDTH) with Gaussian a, so many that a bucket holds about
``BUCKET`` rows.  A query lists perturbed buckets of all tables in order of their estimated success:
the probability, by the normal law of the projected difference, that a neighbour at the expected
distance falls into the bucket.  The list ends where the tables together have met such a neighbour
with probability ``SUCCESS``.  The expected distance is each query's own: that of its k-th neighbour
in a bounded sample (``SAMPLE`` vectors), never nearer than the one in the whole, so it errs towards
more probes.

Every row is indexed under its bucket of each table, packed with its neighbours in the bucket; the
probes, packed likewise, meet the index in an equi-join on the bucket, which broadcasts the probes up
to ``BROADCAST_BYTES`` counted bytes and shuffles beyond.  All queries go through in one pass.  Each
joined pair of blocks is reranked by the exact cosine in double precision of the original vectors, and
the candidates of all tables are merged.  A query that has fewer than k others in the sample, or has
not met k rows at its expected distance or nearer, is answered by a scan of all rows instead.

On nearly uniform vectors of many dimensions no hashing is selective, and this one visits much of the
table to keep its recall; on clustered ones it visits few buckets.

Vectors that are null, zero, or hold null or non-finite components take no part.  A query meets the
vectors of its own dimension, as no other has a cosine with it.  Null ids take no part.  Of repeated
query ids one row asks (the least vector) and rows of that id are its own; repeated candidate ids count
once, with their best score.  Ties go to the smaller id.  Fewer candidates than asked for are all
returned.  Vectors may be of any length.  Extra columns are ignored, whatever their names, and an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables
from .textcore import MULT, U64, mix

TABLES, WIDTH = 4, 1.5
SUCCESS = 0.9
SAMPLE = 2048
#: Rows a bucket should hold, and cells of one hash that unit vectors fill.
BUCKET, CELLS = 40, 6
#: Cells of a hash and buckets of a table that a query's list is drawn from, the likeliest ones.
NEAR_CELLS, LIST = 8, 1024
#: Bytes of probes up to which they are broadcast, and of the queries of one scan of all rows.
BROADCAST_BYTES = SCANNED_BYTES = 32 << 20
SEED = 7
#: Rows of a block, queries of a chunk, and how far rounding may move a score of the block product.
ROWS, CHUNK, SLACK = 8192, 128, 1e-9
_GRID = np.linspace(-8, 8, 4001)
_LAW = np.array([NormalDist().cdf(x) for x in _GRID])


class Hashes:
    """The tables' projections, the buckets of rows, and the probes of queries."""

    def __init__(self, dims: int, rows: int):
        self.functions = int(np.clip(round(np.log(max(rows, 1) / BUCKET) / np.log(CELLS)), 2, 16))
        rng = np.random.default_rng(SEED)
        self.a = rng.normal(size=(dims, TABLES * self.functions))
        self.b = rng.uniform(0, WIDTH, TABLES * self.functions)

    def project(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.a + self.b

    def keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        """One number for each bucket (its cells along the last axis) of a table."""
        key = np.full(cells.shape[:-1], table + 1, U64)
        for j in range(self.functions):
            key = mix(key * U64(MULT) + cells[..., j].astype(np.int64).view(U64))
        return key.view(np.int64)

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """Each row's bucket in each table."""
        cells = np.floor(self.project(unit) / WIDTH).astype(np.int64)
        return np.stack([self.keys(cells[:, t * self.functions : (t + 1) * self.functions], t) for t in range(TABLES)], 1)

    def probes(self, unit: np.ndarray, similarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, bucket) of the buckets that each query visits, each query's in order of estimated success."""
        n, f = len(unit), self.functions
        projected, spread = self.project(unit), (2 - 2 * similarity) ** 0.5
        lowest = np.floor(projected / WIDTH).astype(np.int64) - NEAR_CELLS // 2
        cells = lowest[..., None] + np.arange(NEAR_CELLS + 1)
        edges = np.concatenate([cells, cells[..., -1:] + 1], -1) * WIDTH
        chance = np.diff(np.interp((edges - projected[..., None]) / spread[:, None, None], _GRID, _LAW), axis=-1)
        best = np.argsort(-chance, axis=-1, kind="stable")[..., :NEAR_CELLS]
        cells, chance = np.take_along_axis(cells, best, -1), np.take_along_axis(chance, best, -1)
        keys, odds = [], []
        for t in range(TABLES):
            some, picked = np.ones((n, 1)), np.zeros((n, 1, 0), np.int64)
            for j in range(t * f, (t + 1) * f):
                grown = (some[:, :, None] * chance[:, None, j]).reshape(n, -1)
                keep = np.argsort(-grown, axis=1, kind="stable")[:, :LIST]
                before, cell = keep // NEAR_CELLS, keep % NEAR_CELLS
                picked = np.concatenate([np.take_along_axis(picked, before[..., None], 1), np.take_along_axis(cells[:, j], cell, 1)[..., None]], 2)
                some = np.take_along_axis(grown, keep, 1)
            keys.append(self.keys(picked, t))
            odds.append(some)
        table = np.repeat(np.arange(TABLES), [x.shape[1] for x in odds])
        key, odds = np.concatenate(keys, 1), np.concatenate(odds, 1)
        order = np.argsort(-odds, axis=1, kind="stable")
        missed = np.ones(order.shape)
        for t in range(TABLES):
            missed *= 1 - np.minimum(np.cumsum(np.take_along_axis(odds, order, 1) * (table[order] == t), 1), 1)
        visits = np.concatenate([np.ones((n, 1), bool), missed[:, :-1] > 1 - SUCCESS], 1) & (np.take_along_axis(odds, order, 1) > 0)
        query, rank = np.nonzero(visits)
        return query, key[query, order[query, rank]]


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in an order of summing that does not depend on the block."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _vectors(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


PACKED = "key long, ids binary, vectors binary"


def _packed(ids: np.ndarray, vectors: np.ndarray, owner: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """A row for each key: ids and vectors of its owners."""
    order = np.argsort(key, kind="stable")
    owner, key = owner[order], key[order]
    cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), [len(key)]])
    own = [owner[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    columns = [pa.array(key[cuts[:-1]]), pa.array([ids[x].tobytes() for x in own], pa.binary()), pa.array([vectors[x].tobytes() for x in own], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["key", "ids", "vectors"])


def _indexed(hashes: Hashes, single: bool):
    """Rows packed by bucket; vectors in the precision in which they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            vectors = _vectors(part.column(1), part.num_rows)
            key = hashes.buckets(_unit(vectors))
            for t in range(TABLES):
                yield _packed(part.column(0).to_numpy(), vectors.astype(np.float32 if single else np.float64), np.arange(part.num_rows), key[:, t])

    return run


def _probing(hashes: Hashes, single: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            vectors, expected = _vectors(part.column(1), part.num_rows), part.column(2).to_numpy()
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for a in range(0, part.num_rows, CHUNK):
                some = a + np.flatnonzero(expected[a : a + CHUNK] >= -1)
                if len(some):
                    query, key = hashes.probes(_unit(vectors[some]), np.minimum(expected[some], 0.999))
                    found.append((some[query], key))
            owner, key = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(key):
                yield _packed(part.column(0).to_numpy(), vectors.astype(np.float32 if single else np.float64), owner, key)

    return run


NEAR = "query_id long, vec_id long, score double"


class _Best:
    """The k best candidates of each query among those offered."""

    def __init__(self, k: int):
        self.k, self.held, self.count, self.floor = k, [], 0, 1 << 17

    def offer(self, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        near = np.where(ids == query_ids[:, None], -9.0, _unit(queries) @ _unit(vectors).T)
        each = near
        if len(ids) > self.k:
            by = np.argsort(ids, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], ids[by][1:] != ids[by][:-1]]))
            each = near if len(heads) == len(ids) else np.maximum.reduceat(near[:, by], heads, axis=1)
        cut = np.partition(each, -self.k, axis=1)[:, -self.k] if each.shape[1] > self.k else np.full(len(near), -8.0)
        q, r = np.nonzero((near >= cut[:, None] - SLACK) & (near > -8))
        if len(q):
            self.held.append((query_ids[q], ids[r], cosine(queries[q], vectors[r])))
            self.count += len(q)
        if self.count > self.floor:
            self._shrink()
            self.floor = max(1 << 17, 2 * self.count)

    def _shrink(self) -> None:
        self.held = [_top(*(np.concatenate(x) for x in zip(*self.held, strict=True)), self.k)]
        self.count = len(self.held[0][0])

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._shrink()
            q, v, score = self.held[0]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(score)], ["query_id", "vec_id", "score"])


def _reranked(k: int, single: bool):
    """Joined blocks (ids and vectors of rows, ids and vectors of queries) to the best of each query."""
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                ids, vectors, asking, queries = (x.as_buffer() for x in row)
                ids, asking = np.frombuffer(ids, np.int64), np.frombuffer(asking, np.int64)
                vectors, queries = np.frombuffer(vectors, kind).astype(np.float64).reshape(len(ids), -1), np.frombuffer(queries, kind).astype(np.float64).reshape(len(asking), -1)
                for a in range(0, len(asking), ROWS // 8):
                    best.offer(asking[a : a + ROWS // 8], queries[a : a + ROWS // 8], ids, vectors)
        yield from best.rows()

    return run


def _scanned(queries, k: int):
    """All rows against the broadcast queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw = queries.value
        best = _Best(k)
        for part in _parts(batches):
            vectors = _vectors(part.column(1), part.num_rows)
            for c in range(0, len(ids), CHUNK):
                best.offer(ids[c : c + CHUNK], raw[c : c + CHUNK], part.column(0).to_numpy(), vectors)
        yield from best.rows()

    return run


def _top(q: np.ndarray, v: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, an id once, ties to the smaller id."""
    order = np.lexsort((-score, v, q))
    q, v, score = q[order], v[order], score[order]
    once = np.concatenate([[True], (q[1:] != q[:-1]) | (v[1:] != v[:-1])])
    q, v, score = q[once], v[once], score[once]
    order = np.lexsort((v, -score, q))
    q, v, score = q[order], v[order], score[order]
    heads = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    rank = np.arange(len(q)) - np.repeat(heads, np.diff(np.append(heads, len(q))))
    return q[rank < k], v[rank < k], score[rank < k]


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """id and vector of the rows that take part."""
    v = F.col("vector")
    sound = v.isNotNull() & F.col("id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("vector")).where(sound)


def _expected(sample, k: int):
    """Queries with the cosine of their k-th neighbour in the sample; -2 where it has fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample_ids, unit = sample.value
        for part in _parts(batches):
            ids, own, out = part.column(0).to_numpy(), _unit(_vectors(part.column(1), part.num_rows)), np.full(part.num_rows, -2.0)
            for a in range(0, part.num_rows, 1024):
                near = np.where(ids[a : a + 1024, None] == sample_ids, -2.0, own[a : a + 1024] @ unit.T)
                if len(sample_ids) >= k:
                    out[a : a + 1024] = np.partition(near, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.where(out > -1.5, np.clip(out, -1, 1), -2.0))], ["id", "vector", "expected"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def probed(rows: DataFrame, asking: DataFrame, hashes: Hashes, k: int, single: bool) -> DataFrame:
    """The best candidates of the queries (id, vector, expected) in the buckets that they visit."""
    probes = tables.stored(asking.mapInArrow(_probing(hashes, single), PACKED), "probes")
    size = probes.agg(F.sum(F.octet_length("ids") + F.octet_length("vectors"))).first()[0] or 0
    own = probes.select("key", F.col("ids").alias("asking"), F.col("vectors").alias("queries"))
    own = F.broadcast(own) if size <= BROADCAST_BYTES else own.hint("shuffle_merge")
    met = rows.mapInArrow(_indexed(hashes, single), PACKED).join(own, "key").select("ids", "vectors", "asking", "queries")
    return tables.stored(met.mapInArrow(_reranked(k, single), NEAR), "near")


def scanned(rows: DataFrame, asking: DataFrame, dims: int, k: int) -> list[DataFrame]:
    """The best candidates of the queries (id, vector) among all rows, in blocks of queries."""
    spark, out = rows.sparkSession, []
    each = max(1, SCANNED_BYTES // (16 * dims))
    blocks = -(-asking.count() // each)  # hashing deals unevenly, but never twice as many
    for n in range(blocks):
        block = asking.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).toArrow()
        if block.num_rows:
            queries = spark.sparkContext.broadcast((block["id"].to_numpy(), np.stack(block["vector"].to_numpy()).astype(np.float64)))
            out.append(tables.stored(rows.mapInArrow(_scanned(queries, k), NEAR), "near"))
            queries.destroy()
    return out


def _search(rows: DataFrame, is_query, k: int, single: bool) -> DataFrame | None:
    """The nearest of every query among rows of one dimension."""
    spark: SparkSession = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(SAMPLE).toArrow()
    asking = rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("vector").alias("vector"))
    count, queries = rows.count(), asking.count()
    if not queries:
        return None
    sample_ids, once = np.unique(sample["id"].to_numpy(), return_index=True)
    held = spark.sparkContext.broadcast((sample_ids, _unit(np.stack(sample["vector"].to_numpy()).astype(np.float64)[once])))
    kind = rows.schema["vector"].dataType.simpleString()
    asking = tables.stored(asking.repartition(max(1, queries // ROWS), "id").mapInArrow(_expected(held, k), f"id long, vector {kind}, expected double"), "asking")
    held.destroy()
    found = probed(rows, asking, Hashes(len(sample["vector"][0]), count), k, single)
    kth = _ranked(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
    short = tables.stored(asking.join(kth, "id", "left").where((F.col("expected") < -1) | (F.coalesce("score", F.lit(-2.0)) < F.col("expected") - SLACK)).select("id", "vector"), "short")
    for more in scanned(rows, short, len(sample["vector"][0]), k):
        found = found.unionByName(more)
    return found


def search(vectors: DataFrame, is_query, k: int, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every query row."""
    rows = usable(vectors, id_column, column)
    single = vectors.schema[column].dataType.elementType.simpleString() == "float"
    rows = rows if single else rows.withColumn("vector", F.col("vector").cast("array<double>"))
    found = vectors.sparkSession.createDataFrame([], NEAR)
    for d in sorted(r[0] for r in rows.select(F.size("vector")).distinct().collect()):
        if (own := _search(rows.where(F.size("vector") == d), is_query, k, single)) is not None:
            found = found.unionByName(own)
    return _ranked(found, k)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(tables.read(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, 5)
