"""Learning-curve experiments: the draws of all experiments from a few scans, all their fits in the same ones."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.hashing import hash_uniform
from tagweave.functions.vectors import as_double, l2_normalize, sum_vectors
from tagweave.operators import blocks as B
from tagweave.operators.filters import training_rows
from tagweave.operators.metrics import auc_by_group
from tagweave.operators.sample import learning_curve_size
from tagweave.plans.trials import DEFAULTS, _PARTIAL, _sigmoid, fit_trials
from tagweave.schema import ID
from tagweave.session import cut_lineage

DIGITS = 13        # hex digits of a key, as in hash_uniform
STEP_BITS = 10     # bits of the key that a counting pass settles
COLLECTED = 4096   # rows per draw that may come to the driver to settle the rest
_SCORES = T.StructType([T.StructField("trial", T.IntegerType()), T.StructField("side", T.StringType()), T.StructField("y", T.DoubleType()),
                        T.StructField("p", T.DoubleType())])


def _key(seed, id_col: str) -> Column:
    """The integer behind hash_uniform(seed, id)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, DIGITS), 16, 10).cast("long")


def bounds_of_draws(rows: DataFrame, draws: list[tuple[Column, str, int]], id_col: str = ID) -> list[tuple[int, int] | None]:
    """For each draw (condition, seed, n) the (key, id) of the n-th row by key among those of the condition; None if there are fewer.

    All draws are settled together: a pass counts the rows per next STEP_BITS bits of the key, which tells the range that holds the
    n-th; once ranges are small their rows are fetched. So n rows of any number are drawn exactly without sorting the table.
    """
    bits = 4 * DIGITS
    prefix, rank, done, bound = [0] * len(draws), [n for *_, n in draws], 0, [None] * len(draws)
    key = [_key(seed, id_col) for _, seed, _ in draws]
    open_ = [i for i, (*_, n) in enumerate(draws) if n > 0]
    for i, (*_, n) in enumerate(draws):
        bound[i] = (-1, -1) if n <= 0 else None
    while open_:
        step = min(STEP_BITS, bits - done)
        # The key of draw i is in its range if its leading bits equal the prefix; the next bits are the bin.
        def inside(i):
            return draws[i][0] & (F.shiftright(key[i], bits - done) == prefix[i])
        bins = F.array(*[F.struct(F.lit(i).alias("i"), F.when(inside(i), F.shiftright(key[i], bits - done - step)).alias("bin")) for i in open_])
        counts = (rows.select(F.explode(bins).alias("b")).where("b.bin IS NOT NULL").groupBy("b.i", "b.bin").count()
                  .groupBy("i").agg(F.sort_array(F.collect_list(F.struct("bin", "count"))).alias("bins")).collect())
        done += step
        largest, found = 0, set()
        for r in counts:  # at most 2**STEP_BITS numbers a draw
            seen = 0
            for b in r["bins"]:
                if seen + b["count"] >= rank[r["i"]]:
                    prefix[r["i"]], rank[r["i"]], largest = b["bin"], rank[r["i"]] - seen, max(largest, b["count"])
                    found.add(r["i"])
                    break
                seen += b["count"]
        open_ = [i for i in open_ if i in found]
        if open_ and (largest <= COLLECTED or done == bits):
            ends = F.array(*[F.struct(F.lit(i).alias("i"), F.when(inside(i), key[i]).alias("key"), F.col(id_col).cast("long").alias("id"))
                             for i in open_])
            held: dict[int, list] = {}
            for r in rows.select(F.explode(ends).alias("e")).where("e.key IS NOT NULL").select("e.*").collect():
                held.setdefault(r["i"], []).append((r["key"], r["id"]))
            for i in open_:
                bound[i] = sorted(held[i])[rank[i] - 1]
            break
    return bound


def _first(key: Column, bound, id_col: str) -> Column:
    if bound is None:
        return F.lit(True)
    return (key < bound[0]) | ((key == bound[0]) & (F.col(id_col) <= bound[1]))


def _uniform(seed, value) -> float:
    return int(hashlib.md5(f"{seed}:{value}".encode()).hexdigest()[:DIGITS], 16) / 16.0 ** DIGITS


def sample_and_evaluate(extractors: dict[str, DataFrame], labels: DataFrame, category: str, experiments: int = 10,
                        smallest: int = 20, c: float = 1.0, pos_prob: float | None = None, noise: float = 0.0,
                        domains: bool = False, rescale: bool = False, holdout: bool = False, max_tries: int = 100,
                        seed=0, id_col: str = ID, vec: str = "embedding", normalize: bool = False, steps: int = 150) -> DataFrame:
    """One row per experiment and extractor: size, settings, train and test accuracy, error and AUC.

    An experiment draws a training subsample of the training rows (optionally all domains but one), flips labels, fits a
    logistic regression per extractor and tests on the other domain, on the held-out rows or on the same pool. Vectors can be
    brought to unit length (`normalize`) and to zero mean and unit variance on the experiment's own sample (`rescale`).
    Draws without both classes are repeated; after `max_tries` of them an error is raised, so no experiment is lost. `n` is the
    number of rows drawn, which a rare class can make smaller than asked. A test side without both classes has NULL results.

    The number of Spark jobs does not grow with the experiments: their draws share counting passes, all fits share the scans of
    L-BFGS (at most `steps`), and one pass scores everything.
    """
    spark = labels.sparkSession
    pool = training_rows(labels).where(F.col(category).isNotNull())
    pool = cut_lineage(pool.select(id_col, F.col(category).cast("double").alias("y"), *(["subset"] if domains else [])))
    if domains:
        sizes = {r["subset"]: r["count"] for r in pool.where("subset IS NOT NULL").groupBy("subset").count().collect()}
    else:
        total = pool.count()

    def draw(e: int, attempt: int):
        tag = f"{seed}:{e}:{attempt}"
        test = min(sizes, key=lambda s: (_uniform(f"{tag}:domain", s), s)) if domains else None
        inside = F.col("subset") != test if domains else F.lit(True)
        n = learning_curve_size(sum(sizes.values()) - sizes[test] if domains else total, smallest, tag, e)
        if pos_prob is None:
            sides = [(inside, n)]
        else:
            n_pos = max(1, int(n * pos_prob))
            sides = [(inside & (F.col("y") == 1), n_pos), (inside & (F.col("y") == 0), n - n_pos)]
        return tag, test, sides

    settled, pending = {}, {e: 0 for e in range(experiments)}
    while pending:
        tried = {e: draw(e, a) for e, a in pending.items()}
        asked = [(e, cond, f"{tag}:curve", n) for e, (tag, _, sides) in tried.items() for cond, n in sides]
        found = bounds_of_draws(pool, [a[1:] for a in asked], id_col)
        drawn = {}
        for (e, cond, tag, _), bound in zip(asked, found):
            part = F.coalesce(cond & _first(_key(tag, id_col), bound, id_col), F.lit(False))
            drawn[e] = drawn[e] | part if e in drawn else part
        flip = {e: hash_uniform(f"{tried[e][0]}:noise:y", id_col) < noise for e in tried}
        noisy = {e: F.when(drawn[e], F.when(flip[e], 1 - F.col("y")).otherwise(F.col("y"))) for e in tried}
        seen = pool.agg(*[f(noisy[e]).alias(f"{n}{e}") for e in tried for n, f in (("low", F.min), ("high", F.max), ("n", F.count))]).first()
        for e in tried:
            if seen[f"low{e}"] == 0 and seen[f"high{e}"] == 1:
                settled[e] = (tried[e][1], seen[f"n{e}"], F.when(drawn[e], F.when(flip[e], -1.0).otherwise(1.0)).otherwise(0.0), drawn[e])
                del pending[e]
            else:
                pending[e] += 1
                if pending[e] >= max_tries:
                    raise ValueError(f"no draw of {category!r} has both classes in {max_tries} tries")

    names = list(extractors)
    trials = [{**DEFAULTS, "trial": e * len(names) + i, "extractor": name, "lam": 1.0 / (c * settled[e][1]), "optimizer": "lbfgs"}
              for e in range(experiments) for i, name in enumerate(names)]
    if not trials:
        return spark.createDataFrame([], _RESULT)
    cells = pool.select(
        id_col, F.array("y").alias("y"), F.array(F.lit(1.0)).alias("known"), F.array(*[F.lit(1.0)] * 3).alias("w"),
        F.array(*[settled[e][2] for e in range(experiments) for _ in names]).alias("part"),
        F.array(*[_tested(settled[e], domains, holdout).cast("double") for e in range(experiments) for _ in names]).alias("tested"))
    for i, table in enumerate(extractors.values()):
        cells = cells.join(table.select(id_col, (l2_normalize(vec) if normalize else as_double(vec)).alias(f"x_{i}")), id_col)
    cells = cut_lineage(cells)
    of = [[t for t, trial in enumerate(trials) if trial["extractor"] == name] for name in names]
    scalers = _scalers(cells, of, len(trials)) if rescale else None
    fits = fit_trials(cells, trials, [category], steps, names, scalers)
    found = auc_by_group(_scores(cells, fits, of), ["trial", "side"])

    def result(side, name):
        return F.max(F.when((F.col("side") == side) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col(name)))

    wide = found.groupBy("trial").agg(result("train", "accuracy").alias("train_accuracy"), result("test", "accuracy").alias("test_accuracy"),
                                      result("train", "auc").alias("train_auc"), result("test", "auc").alias("test_auc"))
    about = []
    for t in trials:
        e = t["trial"] // len(names)
        test, n, *_ = settled[e]
        others = ", ".join(sorted(s for s in sizes if s != test)) if domains else None
        about.append((t["trial"], e, t["extractor"], n, float(noise), rescale, normalize, None if pos_prob is None else float(pos_prob), others, test))
    return (spark.createDataFrame(about, _RESULT).join(wide, "trial").drop("trial")
            .withColumns({"train_error": 1 - F.col("train_accuracy"), "test_error": 1 - F.col("test_accuracy")}))


_RESULT = ("trial int, experiment int, extractor string, n long, label_noise double, rescale boolean, normalize boolean, pos_class_prob double, "
           "training_domains string, test_domain string")


def _tested(draw, domains: bool, holdout: bool) -> Column:
    test, _, _, drawn = draw
    if domains:
        return F.coalesce(F.col("subset") == test, F.lit(False))
    return ~drawn if holdout else F.lit(True)


def _scalers(cells: DataFrame, of: list[list[int]], n_trials: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and population standard deviation (1 where constant) of every trial's own sample, from two passes for all."""
    def sums(power: int, centre: list):
        def partial(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                part = np.abs(B.matrix_of(batch.column("part")))
                for n, members in enumerate(of):
                    x = B.matrix_of(batch.column(f"x_{n}"))
                    for i in members:
                        value = np.r_[(part[:, i, None] * (x - centre[i]) ** power).sum(0), part[:, i].sum()]
                        held[i] = held[i] + value if i in held else value
            for i, g in held.items():
                yield B.to_batch({"i": np.array([i], np.int32), "g": B.list_array(g[None, :])}, _PARTIAL)
        found = {r["i"]: np.array(r["g"]) for r in sum_vectors(cells.mapInArrow(partial, _PARTIAL), "i", "g").collect()}
        return [found[i][:-1] / found[i][-1] for i in range(n_trials)]

    mean = sums(1, [0.0] * n_trials)
    scale = [np.sqrt(v) for v in sums(2, mean)]
    return [(m, np.where(s > 0, s, 1.0)) for m, s in zip(mean, scale)]


def _scores(cells: DataFrame, fits, of: list[list[int]]) -> DataFrame:
    """(trial, side, y, p): training rows with the labels that were trained on, test rows with the given ones."""
    def score(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y = B.matrix_of(batch.column("y"))[:, 0]
            part, tested = B.matrix_of(batch.column("part")), B.matrix_of(batch.column("tested"))
            for n, members in enumerate(of):
                x = B.matrix_of(batch.column(f"x_{n}"))
                p = _sigmoid(x @ np.concatenate([fits.weights[i] for i in members], axis=1) + np.concatenate([fits.bias[i] for i in members]))
                for at, i in enumerate(members):
                    for side, used, truth in (("train", part[:, i] != 0, np.where(part[:, i] < 0, 1 - y, y)), ("test", tested[:, i] != 0, y)):
                        k = int(used.sum())
                        yield B.to_batch({"trial": np.full(k, fits.trials[i]["trial"], np.int32), "side": [side] * k, "y": truth[used], "p": p[used, at]}, _SCORES)
    return cells.mapInArrow(score, _SCORES)
