"""Diverse batches: k-means++ seeding, gradient embeddings, one row per cluster."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.hashing import hash_uniform, positive_uniform
from tagweave.functions.vectors import as_double
from tagweave.operators import blocks as B
from tagweave.operators.filters import is_fully_labeled, labeled_ids
from tagweave.operators.features import pca_project, random_projection
from tagweave.operators.neighbors import knn_query
from tagweave.schema import ID, class_columns
from tagweave.session import cut_lineage

REFRESH = 64      # picks between two rewrites of the distance column
AHEAD = 16        # picks prepared by one pass over the data
CANDIDATES = 32   # rows returned per prepared pick

_STATE = T.StructType([T.StructField("id", T.LongType()), T.StructField("open", T.BooleanType()),
                       T.StructField("d2", T.DoubleType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
_BEST = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("id", T.LongType()),
                      T.StructField("key", T.DoubleType()), T.StructField("u", T.DoubleType()),
                      T.StructField("d2", T.DoubleType()), T.StructField("v", T.ArrayType(T.DoubleType()))])


def _shrink(d2, matrix, centres):
    """Smallest squared distance after some new centres; a copy of a centre gets exactly 0."""
    for c in centres:
        d2 = np.minimum(d2, ((matrix - c) ** 2).sum(1))
    return d2


def kpp_sample(vectors: DataFrame, k: int, unavailable: DataFrame | None = None, include: DataFrame | None = None,
               seed=0, id_col: str = ID, vec: str = "embedding", first_uniform: bool = True, mode: str = "exact") -> DataFrame:
    """k-means++ picks as (id, pick): the first uniform, later ones in proportion to the squared distance to the nearest
    unavailable vector (given or already picked). Stops early when no weight is left.

    A draw is an exponential race. A further centre can only shrink distances and so only delay a row, hence the race
    times of a pass are lower bounds for later picks: one pass returns the leading rows of the next AHEAD races, and the
    driver settles pick after pick on them as long as the winner beats every row that was not returned. The distance
    column is updated incrementally: only centres picked since its last rewrite are compared.
    To continue an earlier call, pass its picks as unavailable and first_uniform=False.

    That takes about k / AHEAD passes. For many picks use mode="oversample" (see `kpp_oversample`), whose number of passes does not
    grow with k.
    """
    if mode == "oversample":
        return kpp_oversample(vectors, k, unavailable, include, seed, id_col, vec, first_uniform)
    if mode != "exact":
        raise ValueError(f"mode must be 'exact' or 'oversample', not {mode!r}")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), as_double(vec).alias("v"))
    used = (unavailable.select(F.col(id_col).cast("long").alias("id")).distinct().withColumn("_used", F.lit(True))
            if unavailable is not None else None)
    marked = rows.join(used, "id", "left") if used is not None else rows.withColumn("_used", F.lit(None).cast("boolean"))
    if include is not None:
        wanted = include.select(F.col(id_col).cast("long").alias("id")).distinct().withColumn("_in", F.lit(True))
        marked = marked.join(wanted, "id", "left")
    else:
        marked = marked.withColumn("_in", F.lit(True))
    marked = marked.withColumn("open", F.coalesce("_in", F.lit(False)) & F.col("_used").isNull())
    start = marked.select("id", "open", F.lit(float("inf")).alias("d2"), "v")
    if used is not None:
        taken = rows.join(used, "id", "left_semi")
        near = knn_query(rows, taken, 1, "sqeuclid", "id", "v").select(F.col("src").alias("id"), F.col("dist").alias("_d"))
        start = start.join(near, "id", "left").select("id", "open", F.coalesce("_d", "d2").alias("d2"), "v")
    state = cut_lineage(start)

    picked: list[int] = []
    recent: list[np.ndarray] = []
    gone: list[int] = []
    while len(picked) < k:
        t = len(picked)
        # A uniform first pick ignores distances, and without any centre there are none to look ahead with.
        uniform = t == 0 and first_uniform
        ahead = 1 if t == 0 else min(AHEAD, k - t)
        races = [hash_uniform(f"{seed}:{t}", "id") if uniform else positive_uniform(f"{seed}:{t + j}", "id")
                 for j in range(ahead)]
        leaders = _leaders(state.where("open").withColumn("us", F.array(*races)), recent, gone, uniform, ahead)
        won = _settle(leaders, ahead)
        if not won:
            break
        for row_id, vector in won:
            picked.append(row_id)
            gone.append(row_id)
            recent.append(vector)
        if len(recent) >= REFRESH and len(picked) < k:
            state = cut_lineage(_refresh(state, recent, gone))
            recent, gone = [], []
    return vectors.sparkSession.createDataFrame([(p, i) for i, p in enumerate(picked)], f"{id_col} long, pick int")


def _settle(leaders: dict, ahead: int) -> list:
    """Picks that the returned rows decide, in order; leaders maps a race to rows (key, id, u, d2, v) in key order."""
    won: list[tuple[int, np.ndarray]] = []
    for j in range(ahead):
        rows = leaders.get(j, [])
        complete = len(rows) < CANDIDATES
        best = None
        for key, row_id, u, d2, v in rows:
            if any(row_id == w for w, _ in won):
                continue
            if won:
                d2 = _shrink(np.array([d2]), v[None, :], [c for _, c in won])[0]
                key = -np.log(u) / d2 if d2 > 0 else np.inf
            if np.isfinite(key) and (best is None or (key, row_id) < best[:2]):
                best = (key, row_id, v)
        if best is None or not (complete or j == 0 or best[0] < rows[-1][0]):
            break
        won.append((best[1], best[2]))
    return won


def _leaders(candidates: DataFrame, recent, gone, uniform: bool, ahead: int) -> dict:
    """The first CANDIDATES rows of each race over the whole table."""
    centres, taken = [np.asarray(c) for c in recent], np.asarray(gone, dtype=np.int64)

    def race(batches):
        kept = [None] * ahead
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, m = batch.column("id").to_numpy(), B.matrix_of(batch.column("v"))
            us = B.matrix_of(batch.column("us"))
            d2 = _shrink(batch.column("d2").to_numpy(), m, centres)
            free = ~np.isin(ids, taken)
            for j in range(ahead):
                with np.errstate(divide="ignore"):
                    key = us[:, j] if uniform else np.where(d2 > 0, -np.log(us[:, j]) / d2, np.inf)
                ok = np.nonzero(free & np.isfinite(key))[0]
                ok = ok[np.lexsort((ids[ok], key[ok]))[:CANDIDATES]]
                part = (key[ok], ids[ok], us[ok, j], d2[ok], m[ok])
                if kept[j] is not None:
                    part = tuple(np.concatenate(pair) for pair in zip(kept[j], part))
                    order = np.lexsort((part[1], part[0]))[:CANDIDATES]
                    part = tuple(x[order] for x in part)
                kept[j] = part
        for j, part in enumerate(kept):
            if part is not None and len(part[0]):
                yield B.to_batch({"slot": np.full(len(part[0]), j, np.int32), "id": part[1], "key": part[0], "u": part[2],
                                  "d2": part[3], "v": B.list_array(part[4])}, _BEST)

    found = candidates.select("id", "d2", "us", "v").mapInArrow(race, _BEST)
    first = Window.partitionBy("slot").orderBy("key", "id")
    rows = found.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= CANDIDATES).orderBy("slot", "_r").collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["slot"], []).append((r["key"], r["id"], r["u"], r["d2"], np.asarray(r["v"])))
    return out


def _refresh(state: DataFrame, recent, gone) -> DataFrame:
    centres, taken = [np.asarray(c) for c in recent], np.asarray(gone, dtype=np.int64)

    def update(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, v = batch.column("id").to_numpy(), batch.column("v")
            still = batch.column("open").to_numpy(zero_copy_only=False) & ~np.isin(ids, taken)
            yield B.to_batch({"id": batch.column("id"), "open": still,
                              "d2": _shrink(batch.column("d2").to_numpy(), B.matrix_of(v), centres), "v": v}, _STATE)

    return state.mapInArrow(update, _STATE)


def _distances(vectors: DataFrame, state: DataFrame, centres: DataFrame) -> DataFrame:
    """`state` (id, open, base, d2, near) with the nearest of some more centres taken into account. Vectors are read, not rewritten."""
    near = knn_query(vectors, centres, 1, "sqeuclid", "id", "v").select(F.col("src").alias("id"), F.col("dist").alias("_d"), F.col("dst").alias("_n"))
    closer = F.col("_d").isNotNull() & (F.col("_d") < F.col("_r"))
    joined = state.withColumnRenamed("d2", "_r").join(near, "id", "left")
    # Only picks are counted as near; `base` is the distance to what was unavailable from the start.
    return joined.select("id", "open", "base", F.when(closer, F.col("_d")).otherwise(F.col("_r")).alias("d2"),
                         F.when(closer, F.col("_n")).otherwise(F.col("near")).alias("near"))


def oversampled_candidates(vectors: DataFrame, expected: float, rounds: int, unavailable: DataFrame | None = None,
                           include: DataFrame | None = None, seed=0, id_col: str = ID, vec: str = "embedding", first_uniform: bool = True,
                           at_least: int = 0) -> tuple[DataFrame, DataFrame]:
    """(candidates, state) of the oversampling rounds of k-means||.

    Round 0 takes one open row uniformly. Each further round takes every open row for itself with the probability expected * d2 / (sum of
    d2), d2 being the squared distance to the nearest unavailable row or candidate. More rounds follow until there are `at_least`
    candidates or no distance is left. candidates: (id, round, base); state: (id, open, base, d2, near) for all rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), as_double(vec).alias("v"))
    none = F.lit(None).cast("boolean")
    used = unavailable.select(F.col(id_col).cast("long").alias("id")).distinct() if unavailable is not None else None
    marked = rows.select("id")
    marked = marked.join(used.withColumn("_used", F.lit(True)), "id", "left") if used is not None else marked.withColumn("_used", none)
    if include is not None:
        marked = marked.join(include.select(F.col(id_col).cast("long").alias("id")).distinct().withColumn("_in", F.lit(True)), "id", "left")
    else:
        marked = marked.withColumn("_in", F.lit(True))
    state = marked.select("id", (F.coalesce("_in", F.lit(False)) & F.col("_used").isNull()).alias("open"))
    far = F.lit(float("inf"))
    if used is not None:
        base = knn_query(rows, rows.join(used, "id", "left_semi"), 1, "sqeuclid", "id", "v").select(F.col("src").alias("id"), F.col("dist").alias("base"))
        state = state.join(base, "id", "left").withColumn("base", F.coalesce("base", far))
    else:
        state = state.withColumn("base", far)
    state = cut_lineage(state.select("id", "open", "base", F.col("base").alias("d2"), F.lit(None).cast("long").alias("near")))

    def sampled(no: int, total: float) -> DataFrame:
        if no == 0 and first_uniform or np.isinf(total):
            return state.where("open").orderBy(hash_uniform(f"{seed}:0", "id"), "id").limit(1)
        chance = F.col("d2") * F.lit(expected / total)
        return state.where("open AND d2 > 0").where(hash_uniform(f"{seed}:round:{no}", "id") < chance)

    found, candidates, no, n = [], None, 0, 0
    while no <= rounds or n < at_least:
        total = state.where("open").agg(F.sum("d2")).first()[0]
        if not total or total <= 0:
            break
        fresh = cut_lineage(sampled(no, total).select("id", F.lit(no).alias("round"), "base"))
        n += fresh.count()
        found.append(fresh)
        state = cut_lineage(_distances(rows, state, rows.join(fresh.select("id"), "id", "left_semi")))
        no += 1
    for f in found:
        candidates = f if candidates is None else candidates.unionByName(f)
    if candidates is None:
        candidates = state.where("false").select("id", F.lit(0).alias("round"), "base")
    return candidates, state


DRIVER_BYTES = 64 << 20   # vectors of candidates that may come to the driver


def kpp_oversample(vectors: DataFrame, k: int, unavailable: DataFrame | None = None, include: DataFrame | None = None, seed=0,
                   id_col: str = ID, vec: str = "embedding", first_uniform: bool = True, rounds: int = 5, factor: float = 2.0) -> DataFrame:
    """k picks as (id, pick) by oversampling (k-means||): about `rounds` * `factor` * k candidates from a few passes, each weighted by the number
    of rows that it is nearest to, and weighted k-means++ over the candidates.

    The first pick is that of the exact sampler. Picks are open rows, all different, and none is at distance 0 from an unavailable
    row or another pick; there are fewer than k only if no distance is left. Distances and nearest candidates are a narrow
    table next to the vectors, which are read once a round and never rewritten. What the driver reduces has at most DRIVER_BYTES of vectors;
    more picks than that allows are made in several such turns, each away from the picks before.
    """
    spark = vectors.sparkSession
    width = vectors.select(F.size(vec).alias("d")).limit(1).collect()
    if not width or k <= 0:
        return spark.createDataFrame([], f"`{id_col}` long, pick int")
    turn = max(1, int(DRIVER_BYTES / (8 * max(1, width[0]["d"]) * factor * (rounds + 1))))
    picked: list[int] = []
    while len(picked) < k:
        want = min(turn, k - len(picked))
        taken = unavailable
        if picked:
            mine = spark.createDataFrame([(p,) for p in picked], f"`{id_col}` long")
            taken = mine if unavailable is None else unavailable.select(F.col(id_col).cast("long").alias(id_col)).unionByName(mine)
        tag = f"{seed}" if not picked else f"{seed}:{len(picked)}"
        new = _reduced(vectors, want, taken, include, tag, id_col, vec, first_uniform and not picked, rounds, factor)
        picked += new
        if not new:
            break
    return spark.createDataFrame([(p, i) for i, p in enumerate(picked)], f"`{id_col}` long, pick int")


def _reduced(vectors, k: int, unavailable, include, seed, id_col, vec, first_uniform, rounds, factor) -> list[int]:
    candidates, state = oversampled_candidates(vectors, factor * k, rounds, unavailable, include, seed, id_col, vec, first_uniform, k)
    weight = state.where("open AND near IS NOT NULL").groupBy(F.col("near").alias("id")).agg(F.count(F.lit(1)).alias("w"))
    points = vectors.select(F.col(id_col).cast("long").alias("id"), as_double(vec).alias("v"))
    found = (candidates.join(weight, "id", "left").join(points, "id").orderBy("id")
             .select("id", "round", "base", F.coalesce("w", F.lit(1)).cast("double").alias("w"), "v").toArrow().combine_chunks())
    if not found.num_rows:
        return []
    ids, order, d2, w = (found.column(c).to_numpy() for c in ("id", "round", "base", "w"))
    x = B.matrix_of(found.column("v").chunk(0))
    d2, free, picked = d2.copy(), np.ones(len(ids), bool), []
    rng = np.random.default_rng(_number_of(seed))
    while len(picked) < k:
        if not picked and (first_uniform or np.isinf(d2).all()):
            at = int(np.flatnonzero(order == 0)[0])
        else:
            mass = np.where(free, w * d2, 0.0)
            if not mass.sum() > 0:
                break
            at = int(np.argmin(np.where(mass > 0, -np.log(1 - rng.random(len(ids))) / np.where(mass > 0, mass, 1.0), np.inf)))
        picked.append(int(ids[at]))
        free[at] = False
        d2 = _shrink(d2, x, [x[at]])
    return picked


def _number_of(seed) -> int:
    return int(hashlib.md5(f"{seed}:reduce".encode()).hexdigest()[:13], 16)


def badge_embeddings(hidden: DataFrame, preds: DataFrame, classes, select_class: str | None = None,
                     id_col: str = ID, vec: str = "embedding") -> DataFrame:
    """Gradient of the mean cross-entropy against the rounded own score with respect to the last kernel.

    For a sigmoid layer this is (p_c - [p_c ≥ 0.5]) · h_j / C, flattened with the classes fastest.
    """
    joined = hidden.select(id_col, as_double(vec).alias("_h")).join(preds.select(id_col, *classes), id_col)
    used = [select_class] if select_class else list(classes)
    slopes = F.array(*[(F.col(c) - F.when(F.col(c) >= 0.5, 1.0).otherwise(0.0)) / F.lit(float(len(classes)))
                       for c in used])
    ready = joined.select(id_col, "_h", slopes.alias("_g"))
    grad = F.flatten(F.transform("_h", lambda h: F.transform(F.col("_g"), lambda g: g * h)))
    return ready.select(id_col, grad.alias(vec))


def badge_sample(labels: DataFrame, hidden: DataFrame, preds: DataFrame, n: int, classes=None,
                 select_class: str | None = None, with_excluded: bool = False, id_col: str = ID, vec: str = "embedding",
                 seed=0, mode: str = "exact") -> DataFrame:
    """n k-means++ picks on gradient embeddings, fewer if fewer rows are open; labelled (and optionally excluded) rows are unavailable."""
    from tagweave.operators.filters import unavailable_ids

    classes = class_columns(labels, classes, id_col)
    taken = unavailable_ids(labels, classes, id_col) if with_excluded else labeled_ids(labels, classes, id_col)
    grads = badge_embeddings(hidden, preds, classes, select_class, id_col, vec)
    room = grads.join(taken, id_col, "left_anti").count()
    return kpp_sample(grads, min(n, room), taken, seed=seed, id_col=id_col, vec=vec, mode=mode)


def projected_diversity_sample(labels: DataFrame, vectors: DataFrame, k: int, d_out: int, classes=None,
                               id_col: str = ID, vec: str = "embedding", seed: int = 0) -> DataFrame:
    """Normalise, project at random, then k-means++ picks away from labelled and excluded rows."""
    from tagweave.operators.filters import unavailable_ids

    return kpp_sample(random_projection(vectors, d_out, seed, vec), k,
                      unavailable_ids(labels, class_columns(labels, classes, id_col), id_col), seed=seed,
                      id_col=id_col, vec=vec)


def sample_diversity(labels: DataFrame, vectors: DataFrame, n: int = 20, classes=None, id_col: str = ID,
                     vec: str = "embedding", seed: int = 0, pca_dim: int = 16) -> DataFrame:
    """One random row without full labels from each of n k-means clusters in PCA space: (cluster, id)."""
    from pyspark.ml.clustering import KMeans

    from tagweave.operators.features import to_ml_vector

    classes = class_columns(labels, classes, id_col)
    points = to_ml_vector(pca_project(vectors.select(id_col, vec), pca_dim, vec=vec), vec).select(id_col, "features")
    points.persist()
    try:
        model = KMeans(k=n, seed=seed, featuresCol="features", predictionCol="cluster").fit(points)
    finally:
        points.unpersist()
    done = labels.where(is_fully_labeled(classes)).select(id_col)
    free = model.transform(points).select(id_col, "cluster").join(done, id_col, "left_anti")
    key = F.struct(hash_uniform(f"{seed}:cluster", id_col), F.col(id_col))
    return free.groupBy("cluster").agg(F.min_by(id_col, key).alias(id_col))
