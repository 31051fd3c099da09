"""Exact similarity search: nearest-neighbour graphs and top-k queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.hashing import hash_uniform
from tagweave.functions.vectors import as_double, bind, dot, l2_normalize, lookup
from tagweave.operators import blocks as B
from tagweave.schema import ID
from tagweave.session import cut_lineage

DIGITS = 9            # distances are compared after rounding, so ties break by id in every engine
MAX_CELLS = 2048      # pivots known to every task
CELLS_PER_BLOCK = 4   # cells per block of rows, until MAX_CELLS
BUCKET_GRID = 4       # parts of a hash bucket, of which there are many
CHECKED = 65536       # pairs whose distance is taken component by component at once
EDGE = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()),
                     T.StructField("dist", T.DoubleType())])


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length > 0, length, 1.0)


def _score(metric: str):
    """Smaller is closer. The cosine takes unit vectors."""
    def cosine(q, c):
        return np.round(1.0 - q @ c.T, DIGITS)

    def by_dot(q, c):
        return np.round(-(q @ c.T), DIGITS)

    def sqeuclid(q, c):
        d = (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (q @ c.T)
        return np.round(np.maximum(d, 0.0), DIGITS)

    return {"cosine": cosine, "dot": by_dot, "sqeuclid": sqeuclid}[metric]


def knn_query(queries: DataFrame, corpus: DataFrame, k: int | None, metric: str = "cosine", id_col: str = ID,
              vec: str = "embedding", exclude_self: bool = False, small_rows: int = B.SMALL_ROWS,
              block_rows: int = B.BLOCK_ROWS) -> DataFrame:
    """(src query, dst corpus, dist, rank) with the k closest per query; k=None gives every distance, without rank.

    dist is the cosine distance, the squared Euclidean distance or minus the dot product.
    """
    score = _score(metric)

    def kernel(q_ids, q, c_ids, c):
        d = score(q, c)
        if exclude_self:
            d = np.where(q_ids[:, None] == c_ids[None, :], np.inf, d)
        r, n = B.top_k_rows(d, k if k is not None else len(c_ids))
        return {"src": q_ids[r], "dst": c_ids[n], "dist": d[r, n]}

    found = B.pairwise(queries, corpus, kernel, EDGE, id_col, vec, small_rows=small_rows, block_rows=block_rows,
                       prepare=_unit if metric == "cosine" else None)
    return found if k is None else best_k(found, k)


def best_k(edges: DataFrame, k: int) -> DataFrame:
    """Merge partial lists. The rank filter is pushed below the shuffle, so each task sends at most k rows per query."""
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_graph(df: DataFrame, k: int = 10, id_col: str = ID, vec: str = "embedding",
              block_rows: int = B.BLOCK_ROWS) -> DataFrame:
    """Exact k nearest neighbours of every row by cosine distance, itself excluded: (src, dst, dist, rank).

    Exact copies are searched once and share the result. Vectors are sorted into cells around at most MAX_CELLS pivots
    and each cell is cut into bounded blocks. A block is searched first against itself, which bounds the k-th
    distance of each query; triangle and hyperplane bounds then tell which other cells can hold a closer vector. Blocks
    lie in parts, and a query is sent once to each part that holds such a cell; there it meets these cells only, and what
    it finds tightens its bound. Nothing is dropped: without structure in the data the bounds just keep more cells.
    """
    items = df.select(F.col(id_col).cast("long").alias("id"), as_double(vec).alias("v"))
    total, distinct = items.agg(F.count(F.lit(1)), F.countDistinct(F.xxhash64("v"))).first()
    if total == distinct:
        return best_k(_search(items, total, k, block_rows), k)

    lowest = Window.partitionBy("v").orderBy("id")
    members = (items.withColumn("_r", F.row_number().over(lowest)).where(F.col("_r") <= k + 1)
                    .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("members")))
    members = cut_lineage(members.withColumn("rep", F.element_at("members", 1)))
    found = best_k(_search(members.select(F.col("rep").alias("id"), "v"), distinct, k, block_rows), k)
    near = found.join(members.select(F.col("rep").alias("dst"), "members"), "dst")
    own = members.select(F.col("rep").alias("src"), "members", F.lit(0.0).alias("dist"))
    lists = (near.select("src", "members", "dist").unionByName(own)
                 .select("src", F.explode("members").alias("dst"), "dist"))
    # One more than k per group of copies, because a row must not be its own neighbour.
    lists = best_k(lists, k + 1).groupBy("src").agg(
        F.sort_array(F.collect_list(F.struct("dist", "dst"))).alias("near"))
    group_of = items.join(members.select("v", F.col("rep").alias("src")), "v").select("id", F.col("src").alias("rep"))
    per_item = group_of.join(lists.withColumnRenamed("src", "rep"), "rep")
    cut = per_item.select("id", F.slice(F.filter("near", lambda e: e["dst"] != F.col("id")), 1, k).alias("near"))
    return cut.select(F.col("id").alias("src"), F.posexplode("near").alias("p", "e")).select(
        "src", F.col("e.dst").alias("dst"), F.col("e.dist").alias("dist"), (F.col("p") + 1).cast("int").alias("rank"))


def _near(q: np.ndarray, c: np.ndarray, k: int, bound: np.ndarray | None = None, same: bool = False):
    """(row, column, distance) of the k closest columns per row of unit vectors, no farther than `bound`."""
    s = q @ c.T
    if same:
        np.fill_diagonal(s, -np.inf)
    if bound is not None and np.isfinite(bound).all():
        floor = 1.0 - bound
    elif s.shape[1] > k:
        floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        if bound is not None:
            floor = np.maximum(floor, 1.0 - bound)
    else:
        floor = np.full(len(q), -2.0)
    # The slack keeps everything that rounding could make equal to the last one kept.
    r, n = np.nonzero(s >= floor[:, None] - 4 * 10.0 ** -DIGITS)
    d = np.round(1.0 - s[r, n], DIGITS)
    order = np.lexsort((n, d, r))
    r, n, d = r[order], n[order], d[order]
    keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(q)))[r] < k
    return r[keep], n[keep], d[keep]


def _by_id(table: pa.Table):
    """Ids in order with the matrix and the table arranged alike."""
    ids = table.column("id").combine_chunks().to_numpy(zero_copy_only=False)
    order = np.argsort(ids)
    return ids[order], B.matrix_of(table.column("v").combine_chunks())[order], order


def _search(items: DataFrame, n: int, k: int, block_rows: int) -> DataFrame:
    """Edges (src, dst, dist) that contain the exact k nearest of every row; ids and vectors are unique."""
    located = T.StructType([T.StructField("id", T.LongType()), T.StructField("cell", T.IntegerType()),
                            T.StructField("rho", T.DoubleType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    cells = 1 if n <= block_rows else min(MAX_CELLS, max(1, -(-CELLS_PER_BLOCK * n // block_rows)))
    _, pivots = B.collect_vectors(items.orderBy(hash_uniform("pivot", "id"), "id").limit(cells), "id", "v")
    pivots = _unit(pivots)

    def locate(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            unit = _unit(B.matrix_of(batch.column("v")))
            gap = np.sqrt(np.maximum(2.0 - 2.0 * (unit @ pivots.T), 0.0))
            cell = gap.argmin(1)
            yield B.to_batch({"id": batch.column("id"), "cell": cell.astype(np.int32),
                              "rho": gap[np.arange(len(cell)), cell], "v": B.list_array(unit)}, located)

    placed = items.mapInArrow(locate, located)
    if n > block_rows:
        placed = cut_lineage(placed)
        stats = {r["cell"]: (r["n"], r["radius"]) for r in
                 placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("rho").alias("radius")).collect()}
    else:
        stats = {0: (n, 2.0)}
    chunks = np.array([-(-stats[c][0] // block_rows) if c in stats else 0 for c in range(len(pivots))], dtype=int)
    radius = np.array([stats[c][1] if c in stats else -1.0 for c in range(len(pivots))])
    occupied = chunks > 0
    between = np.sqrt(np.maximum(2.0 - 2.0 * (pivots @ pivots.T), 0.0))

    # Blocks follow each other by cell and chunk and are cut into parts of about equal numbers of rows.
    parts = B.part_count(n, block_rows)
    filled = np.array([stats[c][0] if c in stats else 0 for c in range(len(pivots))], dtype=int)
    before = np.cumsum(filled) - filled

    def part_at(cell, part):
        return (before[cell] + filled[cell] * part // np.maximum(chunks[cell], 1)) * parts // n

    holds = np.zeros((len(pivots), parts), dtype=bool)
    for c in np.nonzero(occupied)[0]:
        holds[c, part_at(c, np.arange(chunks[c]))] = True

    def needed(m, home, bound):
        """Which cells can hold a vector within the bound of each query; its own only if it has other blocks."""
        gap = np.sqrt(np.maximum(2.0 - 2.0 * (m @ pivots.T), 0.0))
        own = (np.arange(len(m)), home)
        apart = np.where(between[home] > 1e-9, between[home], np.inf)
        plane = (gap ** 2 - gap[own][:, None] ** 2) / (2.0 * apart)
        lower = np.maximum(np.maximum(gap - radius[None, :], plane), 0.0)
        lower[own] = 0.0
        out = (lower ** 2 / 2.0 <= bound[:, None] + 1e-7) & occupied[None, :]
        out[own] = chunks[home] > 1
        return out

    size = lookup(np.maximum(chunks, 1), F.col("cell"))
    blocks = placed.select("id", "cell", F.pmod(F.xxhash64("id"), size).cast("int").alias("chunk"), "v")
    edge = T.StructType(EDGE.fields[1:])
    searched = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("home", T.IntegerType()), T.StructField("home_chunk", T.IntegerType()),
        T.StructField("mine", T.IntegerType()), T.StructField("bound", T.DoubleType()),
        T.StructField("parts", T.ArrayType(T.IntegerType())), T.StructField("near", T.ArrayType(edge)),
        T.StructField("v", T.ArrayType(T.DoubleType()))])

    def inside(block: pa.Table) -> pa.Table:
        ids, m, _ = _by_id(block)
        home, part = block.column("cell")[0].as_py(), block.column("chunk")[0].as_py()
        r, c, d = _near(m, m, k, same=True)
        found = np.bincount(r, minlength=len(ids))
        starts = np.concatenate([[0], np.cumsum(found)])
        bound = np.full(len(ids), np.inf)
        full = found == k
        bound[full] = d[starts[1:][full] - 1]
        asked = np.zeros((len(ids), parts), dtype=bool)
        for t in B.tiles(len(ids), len(pivots)):
            asked[t] = needed(m[t], np.full(len(m[t]), home), bound[t]) @ holds
        offsets = np.concatenate([[0], np.cumsum(asked.sum(1))]).astype(np.int32)
        near = pa.StructArray.from_arrays([pa.array(ids[c]), pa.array(d)], ["dst", "dist"])
        every = np.full(len(ids), 1, np.int32)
        return pa.Table.from_batches([B.to_batch({
            "id": ids, "home": home * every, "home_chunk": part * every, "mine": int(part_at(home, part)) * every, "bound": bound,
            "parts": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(asked)[1].astype(np.int32))),
            "near": pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), near), "v": B.list_array(m)}, searched)])

    own = blocks.groupBy("cell", "chunk").applyInArrow(inside, searched)
    if n > block_rows:
        own = cut_lineage(own)
    edges = own.select(F.col("id").alias("src"), F.explode("near").alias("e")).select("src", "e.dst", "e.dist")
    if n <= block_rows:
        return edges

    # The queries of one part meet the blocks of another in one task, if any of them asks for it.
    sent = own.select("id", "home", "home_chunk", "bound", "v", "mine", F.explode("parts").alias("part"))
    some = F.broadcast(sent.select("mine", "part").distinct())
    rows_before, rows_in = lookup(before, F.col("cell")).cast("long"), lookup(filled, F.col("cell")).cast("long")
    place = F.floor((rows_before + F.floor(rows_in * F.col("chunk") / size)) * F.lit(parts) / F.lit(n)).cast("int")
    corpus = blocks.withColumn("part", place).join(some, "part")

    def across(queries: pa.Table, block: pa.Table) -> pa.Table:
        q_ids, q, order = _by_id(queries)
        home, home_chunk, limit = (B.column_of(queries, c)[order] for c in ("home", "home_chunk", "bound"))
        c_ids, c, order = _by_id(block)
        cell, chunk = (B.column_of(block, x)[order] for x in ("cell", "chunk"))
        order = np.lexsort((chunk, cell))
        c_ids, c, cell, chunk = c_ids[order], c[order], cell[order], chunk[order]
        starts = np.concatenate([[0], np.nonzero((np.diff(cell) != 0) | (np.diff(chunk) != 0))[0] + 1, [len(cell)]])
        out = []
        for t in B.tiles(len(q), max(len(pivots), block_rows)):
            found = [np.zeros(0, int)], [np.zeros(0, c_ids.dtype)], [np.zeros(0)]
            bound, waiting, meets = limit[t].copy(), 0, needed(q[t], home[t], limit[t])

            def merge():
                r, m, d = map(np.concatenate, found)
                order = np.lexsort((m, d, r))
                r, m, d = r[order], m[order], d[order]
                place = np.arange(len(r)) - np.searchsorted(r, np.arange(len(bound)))[r]
                last = place == k - 1
                bound[r[last]] = np.minimum(bound[r[last]], d[last])
                return [r[place < k]], [m[place < k]], [d[place < k]]

            for i, j in zip(starts[:-1], starts[1:]):
                asks = np.nonzero(meets[:, cell[i]] & ((home[t] != cell[i]) | (home_chunk[t] != chunk[i])))[0]
                if len(asks) == 0:
                    continue
                r, m, d = _near(q[t][asks], c[i:j], k, bound[asks])
                for held, new in zip(found, (asks[r], c_ids[i:j][m], d)):
                    held.append(new)
                waiting += len(r)
                if waiting > len(bound):
                    found, waiting = merge(), 0
            r, m, d = (x[0] for x in merge())
            out.append(B.to_batch({"src": q_ids[t][r], "dst": m, "dist": d}, EDGE))
        return B.to_table(out, EDGE)

    others = B.meet(sent, corpus, ["mine", "part"], across, EDGE)
    return cut_lineage(edges.unionByName(others))


def knn_graph_lsh(df: DataFrame, k: int = 10, max_distance: float | None = None, id_col: str = ID, vec: str = "embedding",
                  bucket_length: float = 0.5, tables: int = 6, seed: int = 7) -> DataFrame:
    """Approximate graph by random-projection hashing of unit vectors; opt-in where recall below 1 is fine.

    Vectors that share a bucket of a hash table are compared. Buckets are cut into parts that meet in tasks, and a task keeps
    the k closest of each row, so pairs are never rows of a table, however full a bucket is.
    Rows for which the hashes find fewer than k are searched exactly, so every row has k neighbours if there are as many.
    With `max_distance` (between unit vectors) farther pairs are left out, and rows have fewer.
    """
    data = df.select(F.col(id_col).cast("long").alias("id"), l2_normalize(vec).alias("v")).withColumn("x", array_to_vector("v"))
    model = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=bucket_length, numHashTables=tables,
                                        seed=seed).fit(data)
    # Of equal vectors no more than k + 1 can be anyone's neighbours.
    copies = Window.partitionBy("v").orderBy("id")
    rows = cut_lineage(data.drop("x").distinct().withColumn("known", F.row_number().over(copies) <= k + 1))
    hashes = model.transform(rows.withColumn("x", array_to_vector("v"))).select(
        "id", "v", "known", F.posexplode("h").alias("table", "bucket")).withColumn("bucket", vector_to_array("bucket")[0])
    # Only large buckets are listed and cut; the others are one part.
    large = (hashes.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > B.BLOCK_ROWS)
             .select("table", "bucket", B.part_count_column(F.col("n"), B.BLOCK_ROWS, BUCKET_GRID).alias("parts")))
    cut = hashes.join(F.broadcast(large), ["table", "bucket"], "left").na.fill(1, ["parts"])
    cut = cut.withColumn("own", B.part_of(F.col("id"), F.col("parts"))).withColumn("other", B.every_part(F.col("parts"))).drop("parts")
    queries = cut.drop("known").withColumnsRenamed({"own": "mine", "other": "theirs"})
    corpus = cut.where("known").drop("known").withColumnsRenamed({"own": "theirs", "other": "mine"})

    def closest(a: pa.Table, b: pa.Table) -> pa.Table:
        (q_ids, q, _), (c_ids, c, _) = _by_id(a), _by_id(b)
        meet, cc, out = a.column("mine")[0].as_py() == a.column("theirs")[0].as_py(), (c * c).sum(1), []
        for t in B.tiles(len(q), len(c)):
            d2 = (q[t] * q[t]).sum(1)[:, None] + cc[None, :] - 2.0 * (q[t] @ c.T)
            if meet:
                d2[q_ids[t][:, None] == c_ids[None, :]] = np.inf
            bound = np.partition(d2, k - 1, axis=1)[:, k - 1] if d2.shape[1] > k else np.full(len(d2), np.inf)
            # The slack keeps everything that the exact distances could bring among the first k.
            r, n = np.nonzero((d2 <= bound[:, None] + 10.0 ** -DIGITS) & (d2 < np.inf))
            sq = [np.cumsum((q[t][r[i:i + CHECKED]] - c[n[i:i + CHECKED]]) ** 2, axis=1)[:, -1] for i in range(0, len(r), CHECKED)]
            gap = np.sqrt(np.concatenate(sq) if sq else np.zeros(0))
            if max_distance is not None:
                near = gap < max_distance
                r, n, gap = r[near], n[near], gap[near]
            d, m = gap * gap / 2.0, c_ids[n]
            order = np.lexsort((m, d, r))
            r, m, d = r[order], m[order], d[order]
            first = np.arange(len(r)) - np.searchsorted(r, np.arange(len(d2)))[r] < k
            out.append(B.to_batch({"src": q_ids[t][r[first]], "dst": m[first], "dist": d[first]}, EDGE))
        return B.to_table(out, EDGE)

    # A pair may share buckets in several tables.
    pairs = B.meet(queries, corpus, ["table", "bucket", "mine", "theirs"], closest, EDGE).distinct()
    found = best_k(pairs.where(F.col("src") != F.col("dst")), k)
    if max_distance is not None:
        return found
    found = cut_lineage(found)
    full = found.where(F.col("rank") == k).select(F.col("src").alias(id_col))
    short = df.join(full, id_col, "left_anti")
    exact = knn_query(short, df, k, "cosine", id_col, vec, exclude_self=True)
    return found.join(full.withColumnRenamed(id_col, "src"), "src", "left_semi").select("src", "dst", "dist", "rank").unionByName(exact)


def nearest_in_queue(z: DataFrame, queue: DataFrame, id_col: str = ID, vec: str = "embedding") -> DataFrame:
    """For each row the queue vector with the largest dot product: (id, nn_id, nn)."""
    found = knn_query(z, queue, 1, "dot", id_col, vec)
    vectors = queue.select(F.col(id_col).cast("long").alias("nn_id"), as_double(vec).alias("nn"))
    return found.select(F.col("src").alias(id_col), F.col("dst").alias("nn_id"), (-F.col("dist")).alias("dot")).join(
        vectors, "nn_id")


def zero_shot_assign(items: DataFrame, prompts: DataFrame, id_col: str = ID, vec: str = "embedding") -> DataFrame:
    """Give each item (id, prompt, vector) the prompt class (prompt, code, vector) with the largest cosine.

    `code` numbers the prompts in sorted order; ties go to the smaller code.
    """
    own = items.select(id_col, F.col("prompt").alias("own_prompt"))
    codes = prompts.select(F.col("code").cast("long").alias(id_col), vec)
    found = knn_query(items, codes, 1, "cosine", id_col, vec)
    named = found.join(prompts.select(F.col("code").cast("long").alias("dst"), F.col("prompt").alias("assigned")), "dst")
    out = named.select(F.col("src").alias(id_col), "assigned").join(own, id_col)
    return out.withColumn("hit", (F.col("assigned") == F.col("own_prompt")).cast("int"))


def hard_negatives(q: DataFrame, buffer: DataFrame, n: int, s: int = 0, s_prime: int = 0, id_col: str = ID,
                   vec: str = "embedding", seed=0) -> DataFrame:
    """Per query the n buffer vectors with the largest dot product and seeded mixes of them.

    Returns (id, kind, slot, dot) with kind `top`, `mix` (two hard negatives) or `mix_query` (negative and query).
    """
    top = knn_query(q, buffer, n, "dot", id_col, vec)
    vectors = buffer.select(F.col(id_col).cast("long").alias("dst"), as_double(vec).alias("v"))
    lists = (top.join(vectors, "dst").groupBy("src")
                .agg(F.sort_array(F.collect_list(F.struct("rank", (-F.col("dist")).alias("dot"), "v"))).alias("hard")))
    per_query = lists.join(q.select(F.col(id_col).cast("long").alias("src"), as_double(vec).alias("q")), "src")
    tops = per_query.select(F.col("src").alias(id_col), F.explode("hard").alias("h")).select(
        id_col, F.lit("top").alias("kind"), F.col("h.rank").alias("slot"), F.col("h.dot").alias("dot"))

    def chosen(tag, slot):
        at = F.floor(hash_uniform(f"{seed}:{tag}", "src", slot) * F.size("hard")).cast("int") + 1
        return F.element_at("hard", at)["v"]

    def mixes(count, kind):
        slots = per_query.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(count))))
        if kind == "mix":
            a, b = chosen("n1", F.col("slot")), chosen("n2", F.col("slot"))
            share = hash_uniform(f"{seed}:alpha", "src", "slot")
        else:
            a, b = F.col("q"), chosen("n3", F.col("slot"))
            share = hash_uniform(f"{seed}:beta", "src", "slot") * 0.5
        mixed = bind(F.struct(a.alias("a"), b.alias("b"), share.alias("w")), lambda m: F.zip_with(
            m["a"], m["b"], lambda x, y: m["w"] * x + (F.lit(1.0) - m["w"]) * y))
        return slots.withColumn("_m", mixed).select(
            F.col("src").alias(id_col), F.lit(kind).alias("kind"), "slot",
            (dot("_m", "q") / F.sqrt(dot("_m", "_m"))).alias("dot"))

    out = tops
    if s > 0:
        out = out.unionByName(mixes(s, "mix"))
    if s_prime > 0:
        out = out.unionByName(mixes(s_prime, "mix_query"))
    return out
