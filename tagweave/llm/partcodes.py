"""Compression of vectors to one byte per part, with an equal-average search of the codebooks.

Every vector is cut into equal parts and each part is replaced by the index of the nearest entry of its position's codebook.
The codebooks start as the vectors of the smallest ids and are improved by rounds of assignment and averaging, all in
integers, so the result does not depend on how rows are spread over tasks.

Search: the entries of a codebook are sorted by the sum of their components. For any part x and entry c of d components
(sum(x) - sum(c))**2 / d is at most the squared distance. From the place of a part's own sum the search goes outward in
both directions and ends in a direction once that quotient strictly exceeds the best distance found; entries at the same
distance are therefore all seen and the lower index wins.

Cost: one pass over the vectors per round. A task keeps sums and counts per entry (parts * entries * d numbers) and returns
them once, the driver holds the codebooks only; vectors are never shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import Scratch

SCALE = 1024
STEP = 8  # entries looked at in each direction before the bound is tested again
BATCH_BYTES = 32 << 20
TOP = float(1 << 62)
LONG_MAX = (1 << 63) - 1


def encode_parts(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all usable vectors and the final codebooks.

    Returns (rows, codebooks): rows hold `id_col`, `label_col`, code (two hex digits per part, or as many as the last index needs),
    error (squared distance to the coded vector, in integers of 1/1024) and label_error (error summed over rows of one label);
    codebooks[p] is an integer matrix with one line per entry.

    Dropped are rows whose vector is null or empty, holds a null or non-finite component, has a length that `parts` does not divide, or
    another length than the first usable row by id. Null ids come last in that order, so they are coded like others; rows of
    one id are rows of their own, ordered by vector. With fewer usable rows than entries the codebooks are smaller. Null labels
    are one label. Entries that no part uses stay as they are. Scaled components are held within 2**62; large ones are computed
    in unbounded integers, and errors over 2**63 - 1 are given as that number. Other columns are ignored; no rows give no rows and empty codebooks.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "partcodes")
    double = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = (vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), double.alias("v"))
            .where(_finite("v") & (F.size("v") % parts == 0)))
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    start = rows.orderBy(*order).limit(1).select(F.size("v").alias("dim")).collect()
    dim = start[0]["dim"] if start else parts
    rows = scratch.write(rows.where(F.size("v") == dim), "rows")
    first = [r["v"] for r in rows.orderBy(*order).limit(entries).select("v").collect()]
    books = [b.copy() for b in np.split(floor_scaled(np.array(first)), parts, axis=1)] if first else []
    for _ in range(rounds if first else 0):
        sums = (rows.select("v").mapInArrow(_sums(books), "part int, entry int, n long, total array<decimal(38,0)>")
                .select("part", "entry", "n", F.posexplode("total").alias("pos", "x"))
                .groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x")))
        for r in sums.collect():  # at most parts * entries * d numbers
            books[r["part"]][r["entry"], r["pos"]] = int(r["x"]) // r["n"]
    coded = scratch.write(rows.mapInArrow(_codes(books, rows.schema["id"].dataType, rows.schema["label"].dataType),
                                          _coded_schema(rows)), "coded")
    scratch.drop("rows")
    total = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    joined = coded.join(total, F.col("label").eqNullSafe(F.col("of")))
    capped = F.least(F.col("label_error"), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long").alias("label_error")
    return joined.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", capped), books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Checksum of all components as decimal text, joined by commas, in the order of parts, entries, positions."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def _finite(name: str) -> Column:
    inside = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(name).isNotNull() & (F.size(name) > 0) & inside, F.lit(False))


def floor_scaled(v: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of every component, within 2**62."""
    return np.clip(np.floor(v * float(SCALE)), -TOP, TOP).astype(np.int64)


def _computable(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same numbers, as Python integers if squares of their sums could leave 64 bits."""
    limit = (1 << 29) // x.shape[1]
    large = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) > limit
    return (x.astype(object), book.astype(object)) if large else (x, book)


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower index) and squared distance, for every line of x."""
    x, book = _computable(x, book)
    d, m = x.shape[1], len(book)
    sums = book.sum(1)
    by_sum = np.argsort(sums, kind="stable")
    sums, sorted_book = sums[by_sum], book[by_sum]
    own = x.sum(1)
    right = np.searchsorted(sums, own)
    left = right - 1
    best = np.full(len(x), -1, x.dtype)
    index = np.full(len(x), m, np.int64)
    active = np.arange(len(x))
    while len(active):
        # The next entries to the right and to the left; places beyond the ends repeat an end and do no harm.
        at = np.concatenate([right[active, None] + np.arange(STEP), left[active, None] - np.arange(STEP)], axis=1)
        at = np.clip(at, 0, m - 1)
        gap = sorted_book[at] - x[active, None, :]
        dist = (gap * gap).sum(2)
        low = dist.min(1)
        low_index = np.where(dist == low[:, None], by_sum[at], m).min(1)
        better = (best[active] < 0) | (low < best[active]) | ((low == best[active]) & (low_index < index[active]))
        best[active] = np.where(better, low, best[active])
        index[active] = np.where(better, low_index, index[active])
        r, l_, limit = right[active] + STEP, left[active] - STEP, best[active] * d
        more_r = (r < m) & ((sums[np.clip(r, 0, m - 1)] - own[active]) ** 2 <= limit)
        more_l = (l_ >= 0) & ((own[active] - sums[np.clip(l_, 0, m - 1)]) ** 2 <= limit)
        # A direction that has ended goes past its end for good.
        right[active], left[active] = np.where(more_r, r, m), np.where(more_l, l_, -1)
        active = active[more_r | more_l]
    return index, best


def _blocks(batches, dim_of_parts: int):
    """(batch, integer matrix) in pieces of bounded size."""
    for batch in batches:
        width = max(1, dim_of_parts) * STEP * 2 * 8
        step = max(1, BATCH_BYTES // width)
        for at in range(0, len(batch), step):
            piece = batch.slice(at, step)
            v = piece.column("v")
            yield piece, floor_scaled(v.flatten().to_numpy(zero_copy_only=False).reshape(len(piece), -1))


def _sums(books: list[np.ndarray]):
    d = books[0].shape[1] if books else 1
    wide = pa.decimal128(38, 0)

    def run(batches):
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, object) for b in books]
        for _, x in _blocks(batches, d):
            for p, part in enumerate(np.split(x, len(books), axis=1)):
                index, _ = nearest_entries(part, books[p])
                counts[p] += np.bincount(index, minlength=len(books[p]))
                large = np.abs(part).max(initial=0) > LONG_MAX // max(1, len(part))
                local = np.zeros(books[p].shape, object if large else np.int64)
                np.add.at(local, index, part.astype(local.dtype))
                totals[p] += local
        found = [(p, e, counts[p][e], totals[p][e]) for p in range(len(books)) for e in np.flatnonzero(counts[p])]
        yield pa.RecordBatch.from_arrays([
            pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()),
            pa.array([f[2] for f in found], pa.int64()),
            pa.array([[int(t) for t in f[3]] for f in found], pa.list_(wide))], names=["part", "entry", "n", "total"])
    return run


def _coded_schema(rows: DataFrame):
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    return StructType([rows.schema["id"], rows.schema["label"], StructField("code", StringType()), StructField("error", LongType())])


def _codes(books: list[np.ndarray], id_type, label_type):
    d = books[0].shape[1] if books else 1
    digits = max([2] + [len(f"{len(b) - 1:x}") for b in books])

    def run(batches):
        for piece, x in _blocks(batches, d):
            text, error = [""] * len(piece), np.zeros(len(piece), object)
            for p, part in enumerate(np.split(x, len(books), axis=1)):
                index, dist = nearest_entries(part, books[p])
                text = [t + f"{i:0{digits}x}" for t, i in zip(text, index.tolist())]
                error = error + dist
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), piece.column("label"), pa.array(text, pa.string()),
                 pa.array([min(int(e), LONG_MAX) for e in error], pa.int64())], names=["id", "label", "code", "error"])
    return run
