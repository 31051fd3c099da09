"""Measures of representations: contrastive reports, alignment, uniformity, covariance, domain gaps.

Batches of view pairs are packed into blocks; a batch larger than one block is cut into parts that meet in cogroups.
Kernels return sums per anchor, never pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.vectors import array_sum, as_double, dot, l2_normalize, norm, sum_vectors, vector_moments
from tagweave.operators import blocks as B

ANCHOR = T.StructType([
    T.StructField("batch_id", T.LongType()), T.StructField("pair_id", T.LongType()), T.StructField("view", T.IntegerType()),
    T.StructField("pos", T.DoubleType()), T.StructField("n_neg", T.LongType()), T.StructField("neg_sum", T.DoubleType()),
    T.StructField("neg_max", T.DoubleType()), T.StructField("imp_sum", T.DoubleType()),
    T.StructField("imp_neg", T.DoubleType()), T.StructField("cross_sum", T.DoubleType()),
    T.StructField("cross_max", T.DoubleType()), T.StructField("cross_arg", T.LongType())])


SIDE = 256            # rows and columns of a tile of anchors: the matrices of a tile stay in the cache of a core
STEPS = 2048          # table entries for each factor of two of exp
STRIP = 1 << 15       # cells of a tile whose exp is taken at once
EXP_CELLS = 1 << 20   # fewer cells are not worth a table
FIRST = np.iinfo(np.int64).max


class _Exp:
    """exp(factor * s + shift) of tiles, in a matrix that the next call overwrites.

    numpy's exp of doubles takes longer than the product that gives s. Where |s| <= bound keeps the exponents small, a table
    of powers with a parabola between its entries is used instead (relative error below 1e-12).
    """

    def __init__(self, factor: float, shift: float, bound: float, cells: int):
        self.factor, self.shift, self.table = factor, shift, None
        self.e = np.empty(SIDE * SIDE)
        reach = abs(factor) * bound + abs(shift)
        if cells >= EXP_CELLS and reach < 64.0:
            self.step = np.log(2.0) / STEPS
            last = int(np.ceil(reach / self.step)) + 2
            self.table = np.exp(np.arange(-last, last + 1) * self.step)
            # Added to a small number, this leaves its nearest whole number in the low bits.
            self.magic = 1.5 * 2.0 ** 52
            self.first = np.array([self.magic]).view(np.int64)[0] - last
            self.x, self.k, self.at = np.empty(STRIP), np.empty(STRIP), np.empty(STRIP, np.int64)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        out = self.e[:s.size]
        if self.table is None:
            np.multiply(s.ravel(), self.factor, out=out)
            out += self.shift
            return np.exp(out, out=out).reshape(s.shape)
        flat = s.ravel()
        for i in range(0, s.size, STRIP):
            e = out[i:i + STRIP]
            x, k, at = (m[:e.size] for m in (self.x, self.k, self.at))
            np.multiply(flat[i:i + STRIP], self.factor / self.step, out=x)
            if self.shift:
                x += self.shift / self.step
            np.add(x, self.magic, out=k)
            np.subtract(k.view(np.int64), self.first, out=at)
            k -= self.magic
            x -= k
            np.multiply(x, self.step * self.step / 2.0, out=k)
            k += self.step
            k *= x
            np.take(self.table, at, out=e, mode="clip")
            k *= e
            e += k
        return out.reshape(s.shape)


def _best_across(sums: dict, view: int, rows: slice, s: np.ndarray, ids: np.ndarray) -> None:
    """Largest s of each row and the smallest id that attains it, with what earlier tiles gave."""
    best = s.max(1)
    # Only what rounding could make equal to the best is rounded.
    r, c = np.nonzero(s >= (best - 1e-11)[:, None])
    key, former = np.round(best, 12), np.round(sums["cross_max"][view, rows], 12)
    tied = np.round(s[r, c], 12) >= key[r]
    arg, known = np.full(len(s), FIRST), sums["cross_arg"][view, rows]
    np.minimum.at(arg, r[tied], ids[c[tied]])
    sums["cross_arg"][view, rows] = np.select([key < former, key == former, key > former],
                                              [known, np.minimum(known, arg), arg], FIRST)
    sums["cross_max"][view, rows] = np.maximum(sums["cross_max"][view, rows], best)


def _anchor_sums(ia, za, ib, zb, temp: float, eps: float, beta: float, wanted: set) -> list[dict]:
    """The wanted sums of anchors a over b and of anchors b over a, as matrices (view, row), from each product once.

    Without b, of anchors a over themselves, again from one half of the products.
    """
    alone = ib is None
    if alone:
        ib, zb = ia, za
    longest = [max((np.sqrt((m * m).sum(1)).max(initial=0.0) for m in z)) for z in (za, zb)]
    exps = {"neg_sum": (1.0 / temp, eps / temp), "imp_neg": ((1.0 + beta) / temp, 0.0), "cross_sum": (1.0 / temp, -1.0 / temp)}
    if beta:
        exps["imp_sum"] = (beta / temp, 0.0)
    exps = {name: _Exp(*how, longest[0] * longest[1], 4 * len(ia) * len(ib)) for name, how in exps.items() if name in wanted}
    across = exps.pop("cross_sum", None)

    def nothing(n):
        start = {"n_neg": 0, "neg_sum": 0.0, "neg_max": -np.inf, "imp_sum": 0.0, "imp_neg": 0.0, "cross_sum": 0.0,
                 "cross_max": -np.inf, "cross_arg": FIRST}
        return {name: np.full((2, n), value) for name, value in start.items()}

    def tiles_of(n):
        return [(view, slice(i, min(i + SIDE, n))) for view in (0, 1) for i in range(0, n, SIDE)]

    of_a = nothing(len(ia))
    of_b = of_a if alone else nothing(len(ib))
    product, ones, columns = np.empty(SIDE * SIDE), np.ones(SIDE), tiles_of(len(ib))

    def add(sums, name, view, rows, e, by_row):
        sums[name][view, rows] += e @ ones[:e.shape[1]] if by_row else ones[:e.shape[0]] @ e

    for p, (va, a) in enumerate(tiles_of(len(ia))):
        for q in range(p if alone else 0, len(columns)):
            vb, b = columns[q]
            sides = [(of_a, va, a, True)] if alone and p == q else [(of_a, va, a, True), (of_b, vb, b, False)]
            x, y = za[va][a], zb[vb][b]
            s = np.dot(x, y.T, out=product[:len(x) * len(y)].reshape(len(x), len(y)))
            if va != vb and "cross_max" in wanted:
                for sums, view, rows, by_row in sides:
                    _best_across(sums, view, rows, *((s, ib[b]) if by_row else (s.T, ia[a])))
            if va != vb and across:
                e = across(s)
                for sums, view, rows, by_row in sides:
                    add(sums, "cross_sum", view, rows, e, by_row)
            # Equal ids lie in the same part.
            same = np.nonzero(ia[a][:, None] == ib[b][None, :]) if alone else None
            if alone:
                s[same] = -np.inf
            for sums, view, rows, by_row in sides:
                found = np.bincount(same[0 if by_row else 1], minlength=s.shape[0 if by_row else 1]) if alone else 0
                sums["n_neg"][view, rows] += s.shape[1 if by_row else 0] - found
                if "neg_max" in wanted:
                    np.maximum(sums["neg_max"][view, rows], s.max(1 if by_row else 0), out=sums["neg_max"][view, rows])
            if alone:
                s[same] = 0.0
            for name, exp in exps.items():
                e = exp(s)
                if alone:
                    e[same] = 0.0
                for sums, view, rows, by_row in sides:
                    add(sums, name, view, rows, e, by_row)
    out = [of_a] if alone else [of_a, of_b]
    for sums in out:
        if not beta:
            sums["imp_sum"] = sums["n_neg"].astype(float)
    return out


def anchor_stats(views: DataFrame, temp: float, eps: float = 0.0, beta: float = 0.0,
                 block_rows: int = B.BLOCK_ROWS, wanted=ANCHOR.names) -> DataFrame:
    """Per anchor (batch, pair, view) over its batch, from (batch_id, pair_id, z1, z2) with unit vectors:

    pos (dot with the own partner), n_neg, Σ exp((s+eps)/T) and max s over negatives, Σ exp(βs/T) and
    Σ exp(βs/T)·exp(s/T) over negatives, and over the other view of all pairs (own included): Σ exp((s-1)/T), max s
    and the smallest pair id that attains it. Sums and extremes that are not wanted are neither made nor returned.
    """
    wanted = {"batch_id", "pair_id", "view", "pos", "n_neg", *wanted}
    wanted |= {"cross_max", "cross_arg"} if wanted & {"cross_max", "cross_arg"} else set()
    schema = T.StructType([f for f in ANCHOR if f.name in wanted])
    rows = views.select(F.col("batch_id").cast("long").alias("batch_id"), F.col("pair_id").cast("long").alias("pair_id"),
                        as_double("z1").alias("z1"), as_double("z2").alias("z2"))
    # A large batch is cut into an odd number of parts 2h - 1 on a circle. A part meets itself and the next h - 1 parts,
    # so that two parts meet once and a row is sent h times as left and h times as right side.
    half = B.part_count_column(F.col("n"), block_rows)
    sizes = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    biggest, cells = sizes.agg(F.max("n"), F.sum(F.when(F.col("n") > block_rows, half * (2 * half - 1)))).first()

    def stats(batch_id, ia, za, ib=None, zb=None):
        for ids, z, sums in zip((ia, ib), (za, zb), _anchor_sums(ia, za, ib, zb, temp, eps, beta, wanted)):
            own = (z[0] * z[1]).sum(1)
            for view in (0, 1):
                yield B.to_batch({"batch_id": np.full(len(ids), batch_id), "pair_id": ids,
                                  "view": np.full(len(ids), view, np.int32), "pos": own,
                                  **{name: of_view[view] for name, of_view in sums.items()}}, schema)

    def one_block(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = B.packed_rows(batch.column("rows"), i)
                ids, z = r.field("id").to_numpy(), [B.matrix_of(r.field(f)) for f in ("z1", "z2")]
                yield from stats(batch.column("batch_id")[i].as_py(), ids, z)

    def whole(batches):
        return B.pack(batches, ["batch_id"], "pair_id", ["z1", "z2"]).mapInArrow(one_block, schema)

    if (biggest or 0) <= block_rows:
        return whole(rows)

    # Only batches larger than a block are listed: at most one per block of rows, so the rows need not move to be marked.
    large = F.broadcast(sizes.where(F.col("n") > block_rows).select(F.col("batch_id").alias("_large"), half.alias("half")))
    is_large = F.col("batch_id").eqNullSafe(F.col("_large"))
    parts = 2 * F.col("half") - 1
    cut = rows.join(large, is_large).drop("_large").withColumn("own", B.part_of(F.col("pair_id"), parts))
    cut = cut.withColumn("step", B.every_part(F.col("half")))
    left = cut.select("batch_id", "pair_id", "z1", "z2", F.col("own").alias("mine"),
                      F.pmod(F.col("own") + F.col("step"), parts).alias("theirs"))
    right = cut.select("batch_id", "pair_id", "z1", "z2", F.pmod(F.col("own") - F.col("step"), parts).alias("mine"),
                       F.col("own").alias("theirs"))

    def two_parts(a, b):
        batch_id, meet = a.column("batch_id")[0].as_py(), a.column("mine")[0].as_py() == a.column("theirs")[0].as_py()
        both = [(B.column_of(t, "pair_id"), [B.matrix_column(t, f) for f in ("z1", "z2")]) for t in ((a,) if meet else (a, b))]
        return B.to_table(list(stats(batch_id, *(x for side in both for x in side))), schema)

    partial = B.meet(left, right, ["batch_id", "mine", "theirs"], two_parts, schema, cells)
    merge = {"pos": F.max, "neg_max": F.max, "cross_max": F.max, **dict.fromkeys(("n_neg", "neg_sum", "imp_sum", "imp_neg", "cross_sum"), F.sum)}
    sums = [merge[name](name).alias(name) for name in schema.names if name in merge]
    if "cross_arg" in wanted:
        # Ties are told as in the kernel, after rounding.
        sums.append((-F.max(F.struct(F.round("cross_max", 12), -F.col("cross_arg")))["col2"]).alias("cross_arg"))
    merged = partial.groupBy("batch_id", "pair_id", "view").agg(*sums).select(schema.names)
    return merged.unionByName(whole(rows.join(large, is_large, "left_anti")))


def contrast_pairs(views: DataFrame, block_rows: int = B.BLOCK_ROWS) -> DataFrame:
    """The pair structure of each batch, one row per anchor: its positive partner (pair_id, other view), the number of
    negatives (2B-2), the positive similarity and the largest negative similarity. Pairs themselves stay in the kernel."""
    a = anchor_stats(views, 1.0, block_rows=block_rows, wanted=["neg_max"])
    return a.select("batch_id", "pair_id", "view", (F.lit(1) - F.col("view")).alias("positive_view"), "n_neg",
                    F.col("pos").alias("positive"), F.col("neg_max").alias("hardest_negative"))


def contrastive_report(views: DataFrame, temp: float = 0.1, eps: float = 0.0, decoupled: bool = False, q: float = 0.0,
                       lam: float = 0.01, block_rows: int = B.BLOCK_ROWS) -> DataFrame:
    """Per batch: contrastive loss and the share of anchors whose positive beats every negative."""
    if decoupled and q > 0:
        raise ValueError("choose either the decoupled or the robust loss")
    a = anchor_stats(views, temp, eps, block_rows=block_rows, wanted=["neg_sum", "neg_max"])
    logit = (F.col("pos") - F.lit(eps)) / temp
    e_pos = F.exp(logit)
    hit = (logit > (F.col("neg_max") + eps) / temp).cast("double")
    acc = F.avg(F.coalesce(hit, F.lit(1.0))).alias("accuracy")
    if decoupled:
        f = F.exp(F.col("pos") / 0.5)
        sums = a.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum(logit).alias("sp"), F.sum(f * logit).alias("sfp"),
                                         F.sum(f).alias("sf"), F.sum(F.log("neg_sum")).alias("sl"), acc)
        # Σ w·pos with w = 2 - f / mean(f), written with sums only.
        weighted = 2.0 * F.col("sp") - F.col("sfp") * F.col("n") / F.col("sf")
        return sums.select("batch_id", ((F.col("sl") - weighted) / F.col("n")).alias("loss"), "accuracy")
    if q > 0:
        term = -F.pow(e_pos, q) / q + F.pow(e_pos + F.col("neg_sum"), q) * lam / q
    else:
        term = -F.log(e_pos / (e_pos + F.col("neg_sum")) + 1e-8)
    return a.groupBy("batch_id").agg(F.avg(term).alias("loss"), acc)


def hcl_report(views: DataFrame, temp: float = 0.1, beta: float = 1.0, tau_plus: float = 0.1,
               block_rows: int = B.BLOCK_ROWS) -> DataFrame:
    """Hard-negative weighted contrastive loss and accuracy per batch."""
    a = anchor_stats(views, temp, 0.0, beta, block_rows, ["neg_max", "imp_sum", "imp_neg"])
    n = F.col("n_neg").cast("double")
    e_pos = F.exp(F.col("pos") / temp)
    mean_importance = F.col("imp_sum") / (n + 2.0)
    ng = (F.col("imp_neg") / mean_importance - tau_plus * n * e_pos) / (1.0 - tau_plus)
    ng = F.greatest(ng, n * F.exp(F.lit(-1.0 / temp)))
    return a.groupBy("batch_id").agg(
        F.avg(-F.log(e_pos / (e_pos + ng) + 1e-8)).alias("loss"),
        F.avg((F.col("pos") > F.col("neg_max")).cast("double")).alias("accuracy"))


def nce_pair_report(views: DataFrame, temp: float = 0.07, block_rows: int = B.BLOCK_ROWS) -> DataFrame:
    """Two-way softmax cross-entropy of z1·z2ᵀ/T with the diagonal as target; accuracy one way and averaged both ways."""
    unit = views.select("batch_id", "pair_id", l2_normalize("z1").alias("z1"), l2_normalize("z2").alias("z2"))
    a = anchor_stats(unit, temp, block_rows=block_rows, wanted=["cross_sum", "cross_max", "cross_arg"])
    loss = F.log("cross_sum") + (1.0 - F.col("pos")) / temp
    hit = (F.col("cross_arg") == F.col("pair_id")).cast("double")
    return a.groupBy("batch_id").agg(F.avg(loss).alias("loss"), F.avg(F.when(F.col("view") == 0, hit)).alias("accuracy_one_way"),
                                     F.avg(hit).alias("accuracy_two_way"))


QUEUE = T.StructType([T.StructField("pair_id", T.LongType()), T.StructField("q_sum", T.DoubleType()),
                      T.StructField("q_max", T.DoubleType())])


def queue_nce_report(views: DataFrame, buffer: DataFrame, temp: float = 0.07, buffer_id: str = "item_id",
                     vec: str = "embedding", block_rows: int = B.BLOCK_ROWS, small_rows: int = B.SMALL_ROWS) -> DataFrame:
    """Per batch: cross-entropy of z1 against all z2 of the batch plus a buffer of negatives, target = own z2."""
    a = anchor_stats(views, temp, block_rows=block_rows, wanted=["cross_sum", "cross_max", "cross_arg"]).where(F.col("view") == 0)

    def kernel(q_ids, q, c_ids, c):
        s = q @ c.T
        return {"pair_id": q_ids, "q_sum": np.exp((s - 1.0) / temp).sum(1), "q_max": s.max(1)}

    partial = B.pairwise(views.select("pair_id", F.col("z1").alias(vec)), buffer, kernel, QUEUE, "pair_id", vec, buffer_id,
                         small_rows, block_rows)
    queue = partial.groupBy("pair_id").agg(F.sum("q_sum").alias("q_sum"), F.max("q_max").alias("q_max"))
    both = a.join(queue, "pair_id")
    loss = F.log(F.col("cross_sum") + F.col("q_sum")) + (1.0 - F.col("pos")) / temp
    hit = (F.col("cross_arg") == F.col("pair_id")) & (F.col("cross_max") >= F.col("q_max"))
    return both.groupBy("batch_id").agg(F.avg(loss).alias("loss"), F.avg(hit.cast("double")).alias("accuracy"))


# ---- pair measures ----------------------------------------------------------------------------------------------

def alignment(views: DataFrame, alpha: int = 2) -> DataFrame:
    gap = F.zip_with(l2_normalize("z1"), l2_normalize("z2"), lambda x, y: F.pow(x - y, alpha))
    return views.agg(F.avg(array_sum(gap)).alias("alignment"))


def pair_mse(views: DataFrame, other=("p1", "p2")) -> DataFrame:
    """Mean squared error of normalised targets (z1, z2) and predictions, crosswise, both ways added."""
    def mse(a, b):
        gap = F.zip_with(l2_normalize(a), l2_normalize(b), lambda x, y: (x - y) * (x - y))
        return F.avg(array_sum(gap) / F.size(a))

    return views.agg((mse("z1", other[1]) + mse("z2", other[0])).alias("mse"))


def pair_cosine(views: DataFrame) -> DataFrame:
    """Minus the mean dot product of normalised partners."""
    return views.agg((-F.avg(dot("z1", "z2") / (norm("z1") * norm("z2")))).alias("loss"))


UNIFORM = T.StructType([T.StructField("total", T.DoubleType())])


def uniformity(vectors: DataFrame, t: float = 2.0, squared: bool = False, vec: str = "embedding",
               block_rows: int = B.BLOCK_ROWS) -> DataFrame:
    """ln of the mean over all ordered pairs (self included) of exp(-t·distance).

    Exact copies are merged with a weight; each part meets itself and the later ones, the kernel returns one sum.
    """
    merged = vectors.select(as_double(vec).alias("v")).groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("w"))
    n, distinct = merged.agg(F.sum("w"), F.count(F.lit(1))).first()
    parts = B.part_count(distinct or 0, block_rows)
    keyed = merged.withColumn("own", F.pmod(F.hash("v"), F.lit(parts)).cast("int"))
    left = keyed.withColumnRenamed("own", "mine").withColumn("theirs", F.explode(F.sequence(F.col("mine"), F.lit(parts - 1))))
    right = keyed.withColumnRenamed("own", "theirs").withColumn("mine", F.explode(F.sequence(F.lit(0), F.col("theirs"))))

    def kernel(a, b):
        same = a.column("mine")[0].as_py() == a.column("theirs")[0].as_py()
        if same:
            b = a
        (x, wx), (y, wy) = ((B.matrix_column(t, "v"), B.column_of(t, "w")) for t in (a, b))
        yy, total = (y * y).sum(1), 0.0
        for s in B.tiles(len(x), len(y)):
            d2 = np.maximum((x[s] * x[s]).sum(1)[:, None] + yy[None, :] - 2.0 * (x[s] @ y.T), 0.0)
            if same:
                d2[np.arange(len(d2)), np.arange(len(y))[s]] = 0.0
            e = np.exp(-t * (d2 if squared else np.sqrt(d2)))
            total += wx[s] @ e @ wy
        return B.to_table([B.to_batch({"total": [float(total if same else 2.0 * total)]}, UNIFORM)], UNIFORM)

    sums = B.meet(left, right, ["mine", "theirs"], kernel, UNIFORM)
    return sums.agg(F.log(F.sum("total") / F.lit(n * n)).alias("uniformity"))


def avg_cosine(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """Mean of all pairwise cosines = squared norm of the mean unit vector; one aggregate."""
    mean = vector_moments(vectors.select(l2_normalize(vec).alias("v")), "v")
    return mean.select(dot("mean", "mean").alias("avg_cosine"))


def mmd(features: DataFrame, domain: str, num_domains: int, vec: str = "embedding", eps: float = 1e-5) -> DataFrame:
    """Σ over ordered domain pairs of the squared distance of domain means, divided by the number of domains.

    Uses Σ_{i≠j} |μi-μj|² = 2·D·Σ|μi|² - 2·|Σμi|², so domain means meet in one aggregate; empty domains have mean 0.
    """
    means = vector_moments(features, vec, [domain]).select(
        F.transform("mean", lambda m: m * F.col("n") / (F.col("n") + eps)).alias("m"))
    per_dim = means.select(F.posexplode("m").alias("dim", "x")).groupBy("dim").agg(
        F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    return per_dim.agg(((2.0 * num_domains * F.sum("ss") - 2.0 * F.sum(F.col("s") * F.col("s"))) / num_domains).alias("mmd"))


GRAM = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("g", T.ArrayType(T.DoubleType()))])


def gram(df: DataFrame, left: str, right: str) -> DataFrame:
    """Σ over rows of left_i · right_j as (i, j, g). Each task adds its rows up as one matrix before the shuffle."""
    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = B.matrix_of(batch.column("l")).T @ B.matrix_of(batch.column("r"))
                total = part if total is None else total + part
        if total is not None:
            yield B.to_batch({"i": np.arange(len(total), dtype=np.int32), "g": B.list_array(total)}, GRAM)

    pairs = df.select(as_double(left).alias("l"), as_double(right).alias("r"))
    return sum_vectors(pairs.mapInArrow(partial, GRAM), "i", "g").select("i", F.posexplode("g").alias("j", "g"))


def joint_assignment(df: DataFrame, x: str, y: str) -> DataFrame:
    """Symmetrised Σ x_i·y_j as (i, j, p)."""
    g = gram(df, x, y)
    return g.select("i", "j", "g").unionByName(g.select(F.col("j").alias("i"), F.col("i").alias("j"), "g")).groupBy(
        "i", "j").agg((F.sum("g") / 2.0).alias("p"))


def joint_scaled(df: DataFrame, x: str, y: str) -> DataFrame:
    """joint_assignment with the largest cell scaled to 1 (the table has one cell per pair of output units)."""
    p = joint_assignment(df, x, y)
    return p.withColumn("p", F.col("p") / F.max("p").over(Window.partitionBy()))


def mutual_information(df: DataFrame, x: str, y: str, eps: float = 1e-7) -> DataFrame:
    """MI, H and H_cond in nats of two soft assignments."""
    p = joint_assignment(df, x, y).withColumn("p", F.greatest("p", F.lit(eps)))
    everything = Window.partitionBy()
    p = p.withColumn("p", F.col("p") / F.sum("p").over(everything))
    p = p.withColumn("pi", F.sum("p").over(Window.partitionBy("j"))).withColumn("pj", F.sum("p").over(Window.partitionBy("i")))
    # Marginals are equal by symmetry; pi sums over rows, pj over columns.
    cond, h = -F.sum(F.col("p") * (F.log("p") - F.log("pi"))), -F.sum(F.col("p") * F.log("pj"))
    return p.agg((h - cond).alias("mutual_information"), h.alias("entropy"), cond.alias("conditional_entropy"))


def variance_covariance(views: DataFrame, lam: float = 25.0, mu: float = 25.0, nu: float = 1.0, eps: float = 1e-4) -> DataFrame:
    """Invariance, variance and covariance terms of two views and their weighted total."""
    inv = views.agg(F.avg(array_sum(F.zip_with(as_double("z1"), as_double("z2"), lambda a, b: (a - b) * (a - b)))
                          / F.size("z1")).alias("invariance"), F.count(F.lit(1)).alias("n"))
    n = inv.first()["n"]
    sides = []
    for tag, col in (("1", "z1"), ("2", "z2")):
        m = vector_moments(views.select(col), col)
        means = m.select(F.posexplode("mean").alias("i", "m"))
        std = m.select(F.posexplode("var").alias("i", "v")).agg(
            F.avg(F.greatest(F.lit(1.0) - F.sqrt(F.col("v") + eps), F.lit(0.0))).alias("std"), F.count(F.lit(1)).alias("d"))
        g = (gram(views, col, col).join(means, "i")
             .join(means.select(F.col("i").alias("j"), F.col("m").alias("mj")), "j"))
        cov = (F.col("g") - F.lit(float(n)) * F.col("m") * F.col("mj")) / F.lit(float(n - 1))
        off = g.agg(F.sum(F.when(F.col("i") != F.col("j"), cov * cov).otherwise(0.0)).alias("off"))
        sides.append(std.select("std", "d", F.lit(tag).alias("side"), F.lit(None).cast("double").alias("off")).unionByName(
            off.select(F.lit(None).cast("double").alias("std"), F.lit(None).cast("long").alias("d"),
                       F.lit(tag).alias("side"), "off")))
    parts = sides[0].unionByName(sides[1]).agg((F.sum("std") / 2.0).alias("std_term"),
                                               (F.sum("off") / F.max("d")).alias("cov_term"))
    merged = inv.select("invariance", F.lit(None).cast("double").alias("std_term"), F.lit(None).cast("double").alias("cov_term"))
    merged = merged.unionByName(parts.select(F.lit(None).cast("double").alias("invariance"), "std_term", "cov_term"))
    out = merged.agg(F.max("invariance").alias("invariance"), F.max("std_term").alias("std_term"),
                     F.max("cov_term").alias("cov_term"))
    return out.withColumn("total", lam * F.col("invariance") + mu * F.col("std_term") + nu * F.col("cov_term"))
