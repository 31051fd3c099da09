"""Draws with and without replacement.

A draw with replacement is a row of a table of N draws: it gets a stratum and a row number inside the stratum from two
hash uniforms and finds its item with `ranking.find_rows`, which counts the table once and then sorts only the small parts of it
that were drawn. A stratum that holds most of the table stays spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.hashing import hash_uniform
from tagweave.operators.filters import is_unlabeled, training_rows
from tagweave.operators.ranking import find_rows, first_rows, hash_index, ordered_index
from tagweave.schema import ID, class_columns, melt_classes


def strata(df: DataFrame, classes=None, id_col: str = ID) -> DataFrame:
    """Long table (id, class, value) of the known labels of training rows."""
    classes = class_columns(df, classes, id_col)
    long = melt_classes(training_rows(df), classes, [id_col])
    return long.where(F.col("value").isin(0.0, 1.0))


def strata_sizes(df: DataFrame, classes=None, id_col: str = ID) -> list[tuple[str, float, int]]:
    """(class, value, rows) of the non-empty strata; at most two per class, from one aggregate without a shuffle of rows."""
    classes = class_columns(df, classes, id_col)
    counts = training_rows(df).agg(*[F.count_if(F.col(c) == v).alias(f"{i}_{v}")
                                     for i, c in enumerate(classes) for v in (0, 1)]).first()
    sizes = [(c, float(v), counts[f"{i}_{v}"]) for i, c in enumerate(classes) for v in (0, 1)]
    return [s for s in sizes if s[2] > 0]


def stratum_shares(sizes, mode: str) -> list[float]:
    if mode == "class":
        raw = [1.0 for _ in sizes]
    elif mode == "instance":
        raw = [float(n) for *_, n in sizes]
    elif mode == "squareroot":
        raw = [math.sqrt(n) for *_, n in sizes]
    else:
        raise ValueError(f"unknown sampling mode {mode!r}")
    total = sum(raw)
    return [r / total for r in raw]


def sampling_weights(df: DataFrame, mode: str = "class", classes=None, id_col: str = ID) -> DataFrame:
    """Expected share of each training row under `stratified_sample`. The stratum sizes are a handful of numbers, so
    this is one scan with literals."""
    sizes = strata_sizes(df, classes, id_col)
    parts = [F.when(F.col(c) == v, F.lit(p / n)).otherwise(0.0)
             for (c, v, n), p in zip(sizes, stratum_shares(sizes, mode))]
    weight = sum(parts[1:], parts[0]) if parts else F.lit(0.0)
    return training_rows(df).select(id_col, weight.alias("weight")).where(F.col("weight") > 0)


def draw_table(df: DataFrame, n: int, seed) -> DataFrame:
    d = df.sparkSession.range(n).withColumnRenamed("id", "draw")
    return d.withColumn("_u1", hash_uniform(f"{seed}:stratum", "draw")).withColumn("_u2", hash_uniform(f"{seed}:row", "draw"))


def stratified_sample(df: DataFrame, n: int = 1000, mode: str = "class", classes=None, id_col: str = ID,
                      seed=0) -> DataFrame:
    """n draws with replacement: a stratum by `mode`, then a uniform row of it. (draw, id, class, value, labels with -1)."""
    classes = class_columns(df, classes, id_col)
    sizes = strata_sizes(df, classes, id_col)
    if not sizes:
        raise ValueError("no labelled training rows")
    shares, upper, acc = stratum_shares(sizes, mode), [], 0.0
    for p in shares:
        acc += p
        upper.append(acc)
    upper[-1] = 2.0
    choice: Column | None = None
    for (c, v, size), bound in zip(sizes, upper):
        value = F.struct(F.lit(c).alias("class"), F.lit(v).alias("value"), F.lit(size).cast("long").alias("n"))
        choice = F.when(F.col("_u1") < bound, value) if choice is None else choice.when(F.col("_u1") < bound, value)
    draws = draw_table(df, n, seed).withColumn("_s", choice).select(
        "draw", "_s.class", "_s.value", F.floor(F.col("_u2") * F.col("_s.n")).cast("long").alias("row_no"))
    found = find_rows(draws, strata(df, classes, id_col), id_col, n, ["class", "value"], sum(s for *_, s in sizes)).select("draw", id_col, "class", "value")
    labels = df.select(id_col, *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in classes])
    return found.join(labels, id_col)


def grouped_sample(rows: DataFrame, n: int, group: str, id_col: str = ID, seed=0) -> DataFrame:
    """n draws with replacement: a uniform group, then a uniform row of it. Groups are numbered in sorted order."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    numbered = ordered_index(sizes, [group], out="ordinal")
    total = sizes.count()
    draws = (draw_table(rows, n, seed).withColumn("ordinal", F.floor(F.col("_u1") * total).cast("long"))
             .join(numbered, "ordinal")
             .select("draw", "ordinal", group, F.floor(F.col("_u2") * F.col("n")).cast("long").alias("row_no")))
    return find_rows(draws, rows, id_col, n, [group]).select("draw", id_col, group, "ordinal")


def subset_sample(df: DataFrame, n: int = 1000, id_col: str = ID, seed=0) -> DataFrame:
    """n draws over training rows with each subset equally likely."""
    if "subset" not in df.columns:
        raise ValueError("the label table has no subset column")
    rows = training_rows(df).where(F.col("subset").isNotNull()).select(id_col, "subset")
    return grouped_sample(rows, n, "subset", id_col, seed)


def uniform_sample(rows: DataFrame, n: int, id_col: str = ID, seed=0) -> DataFrame:
    """n uniform draws with replacement from all rows."""
    total = rows.count()
    draws = draw_table(rows, n, seed).select("draw", F.floor(F.col("_u2") * total).cast("long").alias("row_no"))
    return find_rows(draws, rows.select(id_col), id_col, n, n_rows=total).select("draw", id_col)


def unlabeled_sample(df: DataFrame, n: int = 1000, classes=None, id_col: str = ID, seed=0) -> DataFrame:
    """n draws with replacement from rows without any label."""
    return uniform_sample(df.where(is_unlabeled(class_columns(df, classes, id_col))), n, id_col, seed)


def tag_batch(df: DataFrame, cls: str, how: str = "uniform", n: int = 9, id_col: str = ID, seed=0) -> DataFrame:
    """Rows to tag next for one class."""
    rows = df.where(F.col(cls).isNull())
    if how == "uniform":
        return first_rows(rows.select(id_col, hash_uniform(seed, id_col).alias("key")), F.col("key"), id_col, n)
    if how == "stratified":
        return grouped_sample(rows.where(F.col("subset").isNotNull()).select(id_col, "subset"), n, "subset", id_col, seed)
    raise ValueError(f"how must be 'uniform' or 'stratified', not {how!r}")


def cluster_stratified(assignment: DataFrame, mult: int = 1, cluster: str = "cluster", id_col: str = ID,
                       seed=0) -> DataFrame:
    """mult·⌊N/K⌋ draws from each non-empty cluster (K = largest cluster number + 1), with a shuffled order key."""
    total, top = assignment.agg(F.count(F.lit(1)), F.max(cluster)).first()
    per = mult * (total // (int(top) + 1))
    sizes = assignment.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    numbered = ordered_index(sizes, [cluster], out="ordinal")
    n = numbered.count() * per
    slots = assignment.sparkSession.range(n).select(
        F.floor(F.col("id") / max(per, 1)).cast("long").alias("ordinal"), F.pmod("id", F.lit(max(per, 1))).alias("slot"))
    draws = slots.join(numbered, "ordinal").select(
        cluster, "slot", F.floor(hash_uniform(f"{seed}:row", cluster, "slot") * F.col("n")).cast("long").alias("row_no"),
        hash_uniform(f"{seed}:order", cluster, "slot").alias("order_key"))
    return find_rows(draws, assignment.select(id_col, cluster), id_col, n, [cluster], total).select(id_col, cluster, "slot", "order_key")


def missingness_weights(df: DataFrame, tasks, id_col: str = ID) -> DataFrame:
    """Row weight: sum over tasks of [known] / (known rows of the task · number of tasks)."""
    known = df.agg(*[F.count(t).alias(t) for t in tasks]).first()
    parts = [F.when(F.col(t).isNotNull(), F.lit(1.0 / (known[t] * len(tasks))) if known[t] else F.lit(0.0)).otherwise(0.0)
             for t in tasks]
    return df.select(id_col, sum(parts[1:], parts[0]).alias("weight"))


def missingness_sample(df: DataFrame, tasks, n: int, balanced: bool = True, id_col: str = ID, seed=0) -> DataFrame:
    """n draws with replacement in proportion to `missingness_weights`, or uniform.

    The weight is a mixture over tasks of the uniform law on the rows known for the task, so a draw picks a task and
    then one of its rows; no running total over rows is needed.
    """
    if not balanced:
        return uniform_sample(df, n, id_col, seed)
    known = df.agg(*[F.count(t).alias(t) for t in tasks]).first()
    present = [t for t in tasks if known[t] > 0]
    long = df.unpivot([id_col], [F.col(t).cast("string").alias(t) for t in present], "task", "category").where(
        F.col("category").isNotNull())
    table = F.array(*[F.struct(F.lit(t).alias("task"), F.lit(known[t]).cast("long").alias("n")) for t in present])
    pick = F.element_at(table, (F.floor(F.col("_u1") * len(present)) + 1).cast("int"))
    draws = draw_table(df, n, seed).withColumn("_t", pick).select(
        "draw", "_t.task", F.floor(F.col("_u2") * F.col("_t.n")).cast("long").alias("row_no"))
    return find_rows(draws, long.select(id_col, "task"), id_col, n, ["task"], sum(known[t] for t in present)).select("draw", id_col, "task")


def learning_curve_size(total: int, smallest: int, seed=0, trial: int = 0) -> int:
    """⌊10^U⌋ with U uniform between log10(smallest) and log10(total)."""
    import hashlib

    u = int(hashlib.md5(f"{seed}:size:{trial}".encode()).hexdigest()[:13], 16) / 16.0 ** 13
    return int(10 ** (math.log10(smallest) + u * (math.log10(total) - math.log10(smallest))))


def learning_curve_subsample(rows: DataFrame, n: int, label: str, pos_prob: float | None = None, id_col: str = ID,
                             seed=0) -> DataFrame:
    """n rows without replacement; with pos_prob, max(1, ⌊n·pos_prob⌋) positives and the rest negatives."""
    keyed = rows.select(id_col, label, hash_uniform(f"{seed}:curve", id_col).alias("key"))
    if pos_prob is None:
        return first_rows(keyed, F.col("key"), id_col, n)
    n_pos = max(1, int(n * pos_prob))
    return first_rows(keyed.where(F.col(label) == 1), F.col("key"), id_col, n_pos).unionByName(
        first_rows(keyed.where(F.col(label) == 0), F.col("key"), id_col, n - n_pos))


def add_label_noise(df: DataFrame, columns, rate: float, id_col: str = ID, seed=0) -> DataFrame:
    """Flip each known 0/1 with probability `rate`."""
    return df.withColumns({c: F.when(hash_uniform(f"{seed}:noise:{c}", id_col) < rate, 1.0 - F.col(c)).otherwise(F.col(c))
                           for c in columns})


def split_domains(df: DataFrame, seed=0, subset: str = "subset") -> DataFrame:
    """Mark one random subset value as the test domain: adds `is_test`. Domains never overlap."""
    name = test_domain(df, seed, subset)
    return df.where(F.col(subset).isNotNull()).withColumn("is_test", F.col(subset) == F.lit(name))


def test_domain(df: DataFrame, seed=0, subset: str = "subset") -> str:
    return df.where(F.col(subset).isNotNull()).agg(
        F.min_by(subset, F.struct(hash_uniform(f"{seed}:domain", subset), F.col(subset)))).first()[0]


def param_samples(spark, n: int, lam=None, learning_rate=None, finetune=None, lr_decay=False, optimizer=False,
                  sampling=False, seed=0) -> DataFrame:
    """n random-search trials: uniform lambda, log-uniform rate, integer epoch and named choices."""
    t = spark.range(n).withColumnRenamed("id", "trial")
    return with_param_draws(t, "trial", lam, learning_rate, finetune, lr_decay, optimizer, sampling, seed)


def with_param_draws(t: DataFrame, key: str, lam=None, learning_rate=None, finetune=None, lr_decay=False,
                     optimizer=False, sampling=False, seed=0) -> DataFrame:
    def u(name):
        return hash_uniform(f"{seed}:{name}", key)

    def choice(name, *values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u(name) * len(values)) + 1).cast("int"))

    if lam is not None:
        t = t.withColumn("lam", F.lit(float(lam[0])) + u("lam") * float(lam[1] - lam[0]))
    if learning_rate is not None:
        lo, hi = math.log(learning_rate[0]), math.log(learning_rate[1])
        t = t.withColumn("learning_rate", F.exp(F.lit(lo) + u("rate") * (hi - lo)))
    if finetune is not None:
        t = t.withColumn("finetune", (F.lit(finetune[0]) + F.floor(u("finetune") * (finetune[1] - finetune[0]))).cast("int"))
    if lr_decay:
        t = t.withColumn("lr_decay", choice("decay", "none", "cosine"))
    if optimizer:
        t = t.withColumn("optimizer", choice("optimizer", "adam", "momentum"))
    if sampling:
        t = t.withColumn("sampling", choice("sampling", "class", "instance", "squareroot"))
    return t


def zip_labeled_unlabeled(sup: DataFrame, unsup: DataFrame, batch: int, mu: int, id_col: str = ID, seed=0) -> DataFrame:
    """Shuffled batches of labelled rows paired by number with batches mu times larger of unlabelled rows.

    Long form (batch_no, role, id); batch numbers stop at the shorter side.
    """
    n_sup, n_unsup = sup.count(), unsup.count()
    batches = min(-(-n_sup // batch), -(-n_unsup // (batch * mu)))

    def side(df, role, size):
        rows = hash_index(df.select(id_col), id_col, seed=f"{seed}:{role}")
        no = F.floor(F.col("row_no") / size).cast("long")
        return rows.select(no.alias("batch_no"), F.lit(role).alias("role"), id_col)

    both = side(sup, "labeled", batch).unionByName(side(unsup, "unlabeled", batch * mu))
    return both.where(F.col("batch_no") < batches)
