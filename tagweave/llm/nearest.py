"""Approximate nearest neighbours on randomly rotated one-bit codes.

Every vector is centred, rotated by a seeded random orthogonal matrix and kept as one sign bit per dimension, its norm
and the inner product of the unit vector with its code. A scan of the codes estimates every squared distance to a
query together with an error bound. The best estimates of a block are compared exactly, which gives a limit; then every
vector whose lower bound is within the limit is compared exactly too.

Cost: a vector moves once, in its block, with d/8 + 16 bytes of code; queries are copied to every tile of blocks. Per
pair of blocks a task returns k + 1 candidates a query, never the pairs. Equal vectors are searched once and expanded at
the end.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import Scratch

CODE_ROWS = 8192
QUERY_ROWS = 256
FIRST = 128
_CODES = "dim int, block long, ids binary, codes binary, norms binary, fits binary, vectors binary"
_NAMES = [c.split()[0] for c in _CODES.split(", ")]


@functools.lru_cache(maxsize=4)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def encode(v: np.ndarray, mean: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits (packed), norms and corrections of the rows of v."""
    r = v - mean
    norm = np.linalg.norm(r, axis=1)
    turned = (r / np.where(norm > 0, norm, 1)[:, None]) @ rotation(v.shape[1], seed)
    fit = np.abs(turned).sum(1) / np.sqrt(v.shape[1])
    return np.packbits(turned >= 0, axis=1), norm, np.where(norm > 0, fit, 1.0)


def bounds(codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, q: np.ndarray, mean: np.ndarray, seed: int,
           width: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances, one row per query."""
    d = q.shape[1]
    r = q - mean
    q_norm = np.linalg.norm(r, axis=1)
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    inner = (r @ rotation(d, seed)).astype(np.float32) @ signs.T / np.sqrt(d) / fit
    slack = width * np.sqrt(np.maximum(1 - fit ** 2, 0)) / fit / np.sqrt(max(d - 1, 1)) + 1e-6
    middle = norm ** 2 + q_norm[:, None] ** 2 - 2 * norm * inner
    reach = 2 * norm * slack * q_norm[:, None]
    return middle - reach, middle + reach


def search(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
           width: float = 2.2, seed: int = 7) -> DataFrame:
    """The k nearest other rows of every row that `queries` selects, by Euclidean distance.

    Returns query_id, rank from 1, the neighbour's id in `id_col`, and score (the exact distance in double precision).
    Ties go to the smaller id. `width` scales the error bounds and with them the recall.

    Rows with a null id, and vectors that are null, empty, zero or hold a null or non-finite component, take no part.
    Of several rows with one id the smallest vector counts. Vectors of another length than the query's are not its
    candidates. Other columns are ignored. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    double = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), double.alias("v"), queries.alias("asked"))
            .where(F.col("id").isNotNull() & usable(F.col("v"))))
    rows = scratch.write(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked")), "rows")
    classes = scratch.write(rows.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
                            .withColumn("dim", F.size("v")), "classes")

    means = (classes.select("dim", F.posexplode("v")).groupBy("dim", "pos").agg(F.avg("col").alias("m"))
             .groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("m")).collect())
    mean = {r["dim"]: np.array([x["m"] for x in r["m"]]) for r in means}
    codes = scratch.write(classes.select("rep", "v", "dim").mapInArrow(_encode_blocks(mean, seed), _CODES), "codes")
    tiles = max(1, min(codes.count(), 4 * spark.sparkContext.defaultParallelism))
    asked = (rows.where("asked").select("id", "v", F.size("v").alias("dim"))
             .mapInArrow(_query_blocks, "dim int, q_ids binary, q_vectors binary")
             .withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))))
    met = codes.withColumn("tile", F.pmod(F.xxhash64("block"), F.lit(tiles)).cast("int")).join(asked, ["dim", "tile"])
    found = scratch.write(met.mapInArrow(_scan(mean, seed, width, k), "query_id long, rep long, score double"), "found")

    by_query = Window.partitionBy("query_id")
    best = (found.withColumn("n", F.row_number().over(by_query.orderBy("score", "rep"))).where(F.col("n") <= k + 1)
            .join(classes.select("rep", "copies"), "rep"))

    # Of a class of copies only its k + 1 smallest ids can be among k neighbours; salted, so a huge class is no one task.
    copies = classes.where("copies > 1").select("v", "rep").join(rows.select("id", "v"), "v").select("rep", "id")
    for keys in (["rep", F.pmod("id", F.lit(256))], ["rep"]):
        copies = (copies.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("id")))
                  .where(F.col("n") <= k + 1).drop("n"))
    spread = (best.where("copies = 1").select("query_id", "score", F.col("rep").alias("id"))
              .unionByName(best.where("copies > 1").join(copies, "rep").select("query_id", "score", "id")))
    order = by_query.orderBy("score", "id")
    return (spread.where("id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))


def _parts(batches, rows: int):
    """(dim, slice) of at most `rows` vectors of one length."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            for at in range(0, len(part), rows):
                yield int(dim), part.slice(at, rows)


def _matrix(part: pa.RecordBatch, dim: int) -> np.ndarray:
    return part.column("v").flatten().to_numpy().reshape(-1, dim)


def _encode_blocks(mean: dict[int, np.ndarray], seed: int):
    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for dim, part in _parts(batches, CODE_ROWS):
            v = _matrix(part, dim)
            bits, norm, fit = encode(v, mean[dim], seed)
            ids = part.column("rep").to_numpy().astype("<i8")
            cells = [x.tobytes() for x in (ids, bits, norm, fit, v)]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([block], pa.int64())]
                                             + [pa.array([x], pa.binary()) for x in cells], names=_NAMES)
            block += 1
    return run


def _query_blocks(batches):
    for dim, part in _parts(batches, QUERY_ROWS):
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array([dim], pa.int32()),
            "q_ids": pa.array([part.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "q_vectors": pa.array([_matrix(part, dim).astype("<f8").tobytes()], pa.binary())})


def scan_block(ids, bits, norm, fit, v, q, mean, seed: int, width: float, k: int):
    """Per query the at most k + 1 nearest of one block: (query row, block row, distance). Ties go to the smaller id."""
    low, high = bounds(bits, norm, fit, q, mean, seed, width)
    middle = low + high
    out = []
    for i in range(len(q)):
        near = np.argpartition(middle[i], FIRST)[:FIRST] if len(ids) > FIRST else np.arange(len(ids))
        exact = np.sqrt(((v[near] - q[i]) ** 2).sum(1))
        if len(ids) > FIRST:
            limit = np.partition(exact, k)[k] if len(exact) > k else np.inf
            near = np.flatnonzero(low[i] <= limit * limit)
            exact = np.sqrt(((v[near] - q[i]) ** 2).sum(1))
        order = np.lexsort((ids[near], exact))[:k + 1]
        out.append((np.full(len(order), i), near[order], exact[order]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _scan(mean: dict[int, np.ndarray], seed: int, width: float, k: int):
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                dim = row["dim"]
                at, col, score = scan_block(
                    ids, np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(row["norms"]),
                    np.frombuffer(row["fits"]), np.frombuffer(row["vectors"]).reshape(-1, dim),
                    np.frombuffer(row["q_vectors"]).reshape(-1, dim), mean[dim], seed, width, k)
                yield pa.RecordBatch.from_pydict({"query_id": q_ids[at], "rep": ids[col], "score": score})
    return run
