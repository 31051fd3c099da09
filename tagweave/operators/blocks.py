"""Blocked work on pairs of vectors.

Pairs are never rows of a table. Both sides are cut into a few parts by hash, part meets part in a cogroup, and a kernel
turns tiles of the two matrices into top-k lists or partial sums per query before anything leaves the task. Every row is
sent once to each part of the other side, so what is shuffled grows with the rows and not with the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.vectors import as_double

SMALL_ROWS = 4096     # a side of at most this many vectors may be sent to every task
BLOCK_ROWS = 2048     # rows per packed block, and of a part at least
GRID = 8              # parts of a side of any size, as long as none has more than PART_ROWS rows
PART_ROWS = 65536     # rows of a part at most, which bounds the memory of a task
TILE = 1 << 21        # cells of the matrix that a kernel works on at once
FEW_CELLS = 1024      # up to so many meetings of parts, tasks are made for them and not for the bytes


def matrix_of(column) -> np.ndarray:
    """Arrow list column to a 2-d array without copying rows one by one."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def packed_rows(column, i: int):
    """The struct array of row i of a list<struct> column."""
    return column[i].values


def pack(df: DataFrame, keys, id_col: str, columns) -> DataFrame:
    """One row per block with its rows sorted by id. The keys must bound the size of a block."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(id_col).alias("id"), *columns)))
    return df.groupBy(*keys).agg(rows.alias("rows"))


def to_batch(columns: dict, schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    arrays = [pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array)
              else columns[f.name].cast(f.type) for f in target]
    return pa.RecordBatch.from_arrays(arrays, schema=target)


def list_array(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(matrix.shape[0] + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def part_count(n: int, block_rows: int = BLOCK_ROWS, grid: int = GRID) -> int:
    """Parts of a side of n rows: `grid`, fewer where parts would be smaller than a block, more only above PART_ROWS."""
    return max(1, -(-n // max(block_rows, min(-(-n // grid), PART_ROWS))))


def part_count_column(n: Column, block_rows: int = BLOCK_ROWS, grid: int = GRID) -> Column:
    """`part_count` of a column of sizes."""
    rows = F.greatest(F.lit(block_rows), F.least(F.ceil(n / grid), F.lit(PART_ROWS)))
    return F.greatest(F.ceil(n / rows), F.lit(1)).cast("int")


def part_of(key: Column, parts) -> Column:
    return F.pmod(F.xxhash64(key), parts if isinstance(parts, Column) else F.lit(parts)).cast("int")


def every_part(parts) -> Column:
    """One row for each part."""
    parts = parts if isinstance(parts, Column) else F.lit(parts)
    return F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))


def meet(left: DataFrame, right: DataFrame, keys: list[str], work, schema: T.StructType, cells: int | None = None) -> DataFrame:
    """work(left rows, right rows) -> arrow table, for each value of the keys. Both sides may come from one table.

    `cells`: about how many values the keys have. Few of them get tasks of their own, but for those that share a hash.
    """
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))
    if cells and cells <= FEW_CELLS:
        left, right = (df.repartition(2 * cells, *keys) for df in (left, right))

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        return work(a, b) if a.num_rows and b.num_rows else to_table([], schema)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(both, schema)


def tiles(rows: int, columns: int) -> list[slice]:
    """Slices of the rows whose cells with all columns fit a tile."""
    step = max(1, TILE // max(1, columns))
    return [slice(i, i + step) for i in range(0, rows, step)]


def column_of(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def matrix_column(table: pa.Table, name: str) -> np.ndarray:
    return matrix_of(table.column(name).combine_chunks())


def to_table(batches: list[pa.RecordBatch], schema: T.StructType) -> pa.Table:
    """Batches as the table that a grouped function returns; none give no rows."""
    return pa.Table.from_batches(batches or [to_batch({f.name: [] for f in schema}, schema)])


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def collect_vectors(df: DataFrame, id_col: str, vec: str):
    """Ids and matrix of a table whose size was checked before."""
    table = df.select(F.col(id_col).cast("long").alias("id"), as_double(vec).alias("v")).orderBy("id").toArrow()
    table = table.combine_chunks()
    ids = table.column("id").to_numpy()
    if len(ids) == 0:
        return ids, np.zeros((0, 1))
    return ids, matrix_of(table.column("v").chunk(0))


def pairwise(queries: DataFrame, corpus: DataFrame, kernel, schema: T.StructType, id_col: str, vec: str,
             corpus_id: str | None = None, small_rows: int = SMALL_ROWS, block_rows: int = BLOCK_ROWS, prepare=None) -> DataFrame:
    """Run kernel(query ids, query matrix, corpus ids, corpus matrix) -> dict of columns so that all pairs are met once.

    A side of at most `small_rows` rows is shipped to the tasks, which then stream the other side without a shuffle.
    Otherwise both sides are hashed into parts and every part of the queries meets each part of the corpus in one task.
    The kernel gets some queries at a time, with all rows of the corpus part or batch; `prepare` changes each matrix before.
    """
    corpus_id = corpus_id or id_col
    q = queries.select(F.col(id_col).cast("long").alias("id"), as_double(vec).alias("v"))
    c = corpus.select(F.col(corpus_id).cast("long").alias("id"), as_double(vec).alias("v"))
    prepare = prepare or (lambda m: m)

    def by_tile(q_ids, q_rows, c_ids, c_rows):
        order = np.argsort(c_ids, kind="stable")
        c_ids, c_rows = c_ids[order], c_rows[order]
        for s in tiles(len(q_ids), len(c_ids)):
            yield to_batch(kernel(q_ids[s], q_rows[s], c_ids, c_rows), schema)

    for fixed, streamed, swap in ((c, q, False), (q, c, True)):
        if is_small(fixed, small_rows):
            ids, matrix = collect_vectors(fixed, "id", "v")
            if len(ids) == 0:
                return q.sparkSession.createDataFrame([], schema)
            matrix = prepare(matrix)

            def stream(batches, ids=ids, matrix=matrix, swap=swap):
                for batch in batches:
                    if batch.num_rows == 0:
                        continue
                    mine = batch.column("id").to_numpy(), prepare(matrix_of(batch.column("v")))
                    yield from by_tile(ids, matrix, *mine) if swap else by_tile(*mine, ids, matrix)

            return streamed.mapInArrow(stream, schema)
    q_parts, c_parts = part_count(q.count(), block_rows), part_count(c.count(), block_rows)
    left = q.withColumn("qp", part_of(F.col("id"), q_parts)).withColumn("cp", every_part(c_parts))
    right = c.withColumn("cp", part_of(F.col("id"), c_parts)).withColumn("qp", every_part(q_parts))

    def part(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = ((column_of(t, "id"), prepare(matrix_column(t, "v"))) for t in (a, b))
        return to_table(list(by_tile(*a, *b)), schema)

    return meet(left, right, ["qp", "cp"], part, schema)


def top_k_rows(score: np.ndarray, k: int, limit: np.ndarray | None = None):
    """Row and column numbers of the k smallest scores per row; ties go to the smaller column number."""
    rows, cols = score.shape
    if cols > k:
        bound = np.partition(score, k - 1, axis=1)[:, k - 1]
    else:
        bound = np.full(rows, np.inf)
    if limit is not None:
        bound = np.minimum(bound, limit)
    r, c = np.nonzero((score <= bound[:, None]) & np.isfinite(score))
    order = np.lexsort((c, score[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, np.arange(rows))
    keep = np.arange(len(r)) - first[r] < k if len(r) else np.zeros(0, bool)
    return r[keep], c[keep]
