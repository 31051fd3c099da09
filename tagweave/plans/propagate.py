"""Label propagation over a nearest-neighbour graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.neighbors import knn_graph
from tagweave.schema import ID, class_columns, is_true
from tagweave.session import bucketed_copy, cut_lineage, drop_copies

HUB_EDGES = 100_000       # in-edges of one node that may share a join key
CUT_EVERY = 5


def edge_weights(graph: DataFrame, temp: float = 0.01) -> DataFrame:
    """(src, dst, w): exp(-dist/T) scaled by D^-1/2 on both sides, D = row sums of the directed graph."""
    raw = graph.select("src", "dst", F.exp(-F.col("dist") / temp).alias("a"))
    degree = raw.groupBy("src").agg((F.lit(1.0) / F.sqrt(F.sum("a"))).alias("s"))
    out = raw.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("s").alias("t")), "dst")
    return out.select("src", "dst", (F.col("a") * F.col("s") * F.col("t")).alias("w"))


def propagate_labels(labels: DataFrame, graph: DataFrame | None = None, vectors: DataFrame | None = None,
                     iterations: int = 20, n_neighbors: int = 10, temp: float = 0.01, classes=None, id_col: str = ID,
                     vec: str = "embedding") -> DataFrame:
    """Spread known training labels: (id, class scores), NULL where nothing arrived.

    State is a negative and a positive mass per class. Only the cell that a label sets to 1 is clamped each round. Edges
    and seeds are written once as bucketed tables and stay in place: a round moves the non-zero state rows to the edges
    and partial sums to the sources. Targets with very many in-edges are split into parts that each receive the state row.
    """
    spark = labels.sparkSession
    classes = class_columns(labels, classes, id_col)
    if graph is None:
        graph = knn_graph(vectors, n_neighbors, id_col, vec)
    graph = cut_lineage(graph.select("src", "dst", "dist"))      # read three times below
    weighted = edge_weights(graph, temp)
    # Only nodes with very many in-edges are listed, at most one per HUB_EDGES edges.
    hubs = graph.groupBy("dst").agg(F.ceil(F.count(F.lit(1)) / HUB_EDGES).cast("int").alias("parts")).where(F.col("parts") > 1)
    placed = weighted.join(hubs, "dst", "left").na.fill(1, ["parts"]).withColumn("part", F.pmod(F.xxhash64("src"), F.col("parts")).cast("int"))
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges, edge_table = bucketed_copy(placed.select("src", "dst", "part", "w"), ["dst", "part"], slots)

    train = ~is_true("exclude") & ~is_true("validation")
    cells, hard = [], []
    for i, c in enumerate(classes):
        for v in (0, 1):
            cells.append(f"c{i}_{v}")
            hard.append(F.when(train & (F.col(c) == v), 1.0).alias(f"h{i}_{v}"))
    seeds = labels.select(F.col(id_col).cast("long").alias("id"), *hard)
    names = [f"h{x[1:]}" for x in cells]
    seeds, seed_table = bucketed_copy(seeds.join(hubs.withColumnRenamed("dst", "id"), "id", "left").na.fill(1, ["parts"]),
                                      ["id"], slots)
    state = seeds.select("id", "parts", *[F.coalesce(h, F.lit(0.0)).alias(x) for h, x in zip(names, cells)])

    for round_no in range(iterations):
        some = F.greatest(*cells) > 0
        sent = state.where(some).select(
            F.col("id").alias("dst"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *cells)
        summed = edges.join(sent, ["dst", "part"]).groupBy(F.col("src").alias("id")).agg(
            *[F.sum(F.col("w") * F.col(x)).alias(f"n_{x}") for x in cells])
        state = seeds.join(summed, "id", "left").select(
            "id", "parts", *[F.coalesce(F.col(h), F.col(f"n_{x}"), F.lit(0.0)).alias(x) for h, x in zip(names, cells)])
        if (round_no + 1) % CUT_EVERY == 0 and round_no + 1 < iterations:
            state = cut_lineage(state)
    state = cut_lineage(state)
    drop_copies(spark, edge_table, seed_table)

    scores = []
    for i, c in enumerate(classes):
        total = F.col(f"c{i}_0") + F.col(f"c{i}_1")
        scores.append(F.when(total > 0, F.col(f"c{i}_1") / total).alias(c))
    return state.select(F.col("id").alias(id_col), *scores)
