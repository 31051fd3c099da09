"""Near-duplicate documents by one-permutation MinHash with optimal densification.

One hash of every word shingle fills `BINS` bins with their smallest values; an empty bin copies the bin that its own
sequence of hashed draws finds first. Bands of `ROWS` bins are bucket keys. Documents with equal shingle sets are one class
and only its smallest doc_id goes on. Inside a bucket every member is paired with one centre, so a bucket of n members
gives n - 1 pairs; pairs are confirmed on whole shingle sets and linked pairs joined to components.

A star can miss a link between two members that both differ from the centre. So where a bucket's members are still in more
than one component, the members of different components are compared too: in tiles of at most 2 * TILE_ROWS documents, on
whole signatures first and on whole sets where the estimate allows a link. A tile returns links only, never its pairs.

With 42 bands of 6 bins a pair of similarity 0.8 shares no bucket with probability 3e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import Cache, Scratch, arrow_rows
from tagweave.llm.components import components
from tagweave.llm.substring import runs_of

ROWS, BANDS = 6, 42
BINS = ROWS * BANDS
EDGES = (np.arange(BINS, dtype=object) * (1 << 64) // BINS).astype(np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
TILE_ROWS = 1024
SLACK = 0.12


def shingle_set(cache: Cache, text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle, one without words none."""
    words = text.lower().split() if text else []
    codes = np.frombuffer(b"".join(map(cache.__getitem__, words)), ">u8").astype(np.uint64)
    return np.unique(runs_of(codes, min(k, len(codes)))) if len(codes) else codes


def signature(shingles: np.ndarray) -> np.ndarray:
    """One value per bin. The bins are equal ranges of the hash, so a sorted set gives each bin's minimum at its start."""
    start = np.searchsorted(shingles, EDGES)
    end = np.r_[start[1:], len(shingles)]
    source = np.where(start < end, np.arange(BINS), -1)
    filled = source >= 0
    empty, draw = np.flatnonzero(~filled), np.zeros(1, np.uint64)
    while len(empty):
        draw += _B
        h = (empty.astype(np.uint64) * _A + draw) * _C
        found = ((h ^ (h >> np.uint64(31))) * _A >> np.uint64(33)).astype(np.int64) % BINS
        hit = filled[found]
        source[empty[hit]] = found[hit]
        empty = empty[~hit]
    return shingles[start[source]]


def band_keys(bins: np.ndarray) -> np.ndarray:
    rows = bins.reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64) * _B
    for j in range(ROWS):
        h = (h ^ (h >> np.uint64(29))) * _A + rows[:, j]
    return ((h ^ (h >> np.uint64(32))) * _C).view(np.int64)


def near_duplicates(docs: DataFrame, shingle_words: int = 2, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union.

    Returns per row of `docs`: doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept
    (doc_id = component_id). Words are runs of other than ASCII white space with A-Z lower-cased.

    A document without words, or a null text, has the empty set and links with nothing. Rows of one doc_id are one
    document: they share a component, and each row gives a result. Rows with a null doc_id link with nothing, have a null
    component_id and are kept. Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    signed = scratch.write(rows.mapInArrow(_sign(shingle_words),
                           "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "signed")
    full = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = scratch.write(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.join(classes, ["k1", "k2"]).where("doc_id = rep").select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    reps = scratch.write(reps.distinct(), "reps")
    multi = reps.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre < last")
    members = scratch.write(reps.join(multi.select("bucket", "centre"), "bucket"), "members")
    scratch.drop("reps")

    nodes = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = scratch.write(rows.join(nodes, "doc_id", "left_semi").mapInArrow(_sets(shingle_words), "rep long, shingles array<long>, bins binary"),
                         "sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (u, v) whose whole sets are similar enough."""
        of = {c: sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "uv"}
        both = F.size(F.array_intersect("set_u", "set_v"))
        union = F.size("set_u") + F.size("set_v") - both
        fits = F.least(F.size("set_u"), F.size("set_v")) * 100 >= F.greatest(F.size("set_u"), F.size("set_v")) * percent
        return scratch.write(pairs.join(of["u"], "u").join(of["v"], "v").where(fits).where(both * 100 >= union * percent)
                             .select("u", "v"), name)

    star = members.where("rep <> centre").select(F.col("rep").alias("u"), F.col("centre").alias("v")).distinct()
    # A doc_id with several texts ties their classes together.
    key = F.struct("k1", "k2")
    several = full.groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("doc_id")
    ties = (full.join(several, "doc_id", "left_semi").join(classes, ["k1", "k2"])
            .select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    links = confirmed(scratch.write(star, "star"), "links").unionByName(ties)
    root = components(links, scratch, "first")

    labelled = (members.select("bucket", "rep").join(root, F.col("rep") == F.col("node"), "left")
                .select("bucket", "rep", F.coalesce("root", "rep").alias("root")))
    mixed = (labelled.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"))
             .where("lo < hi").select("bucket", F.ceil(F.col("n") / TILE_ROWS).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    tiled = (labelled.join(mixed, "bucket").withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "root"))
    more = scratch.write(tiled.join(sets, "rep").groupBy("bucket", "i", "j").applyInArrow(_tile(percent), "u long, v long").distinct(),
                         "more")
    root = components(root.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more), scratch, "second")
    scratch.drop("sets", "members")

    root = root.select(F.col("node").alias("rep"), "root")
    of_class = classes.join(root, "rep", "left").select("k1", "k2", F.coalesce("root", "rep").alias("component_id"))
    named = (signed.join(of_class, ["k1", "k2"], "left")
             .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))))
    return named.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _sign(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                        ("bands", pa.list_(pa.int64()))])

    def rows(batches):
        cache = Cache(xxhash.xxh3_64_digest)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                s = shingle_set(cache, text.as_py(), k)
                if not len(s):
                    yield doc.as_py(), 0, None, None, None
                    continue
                key = xxhash.xxh3_128_digest(s.tobytes())
                k1, k2 = np.frombuffer(key, np.int64).tolist()
                yield doc.as_py(), len(s), k1, k2, band_keys(signature(s))
            cache.trim()

    return lambda batches: arrow_rows(schema, rows(batches))


def _sets(k: int):
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.list_(pa.int64())), ("bins", pa.binary())])

    def rows(batches):
        cache = Cache(xxhash.xxh3_64_digest)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                s = shingle_set(cache, text.as_py(), k)
                yield doc.as_py(), s.view(np.int64), (signature(s).astype(np.uint8).tobytes() if len(s) else b"")
            cache.trim()

    return lambda batches: arrow_rows(schema, rows(batches), weigh=lambda r: 8 * len(r[1]))


def _tile(percent: int):
    """Links between members of different components in one tile of a bucket."""
    def run(key: tuple, group: pa.Table) -> pa.Table:
        rep, root = group.column("rep").to_numpy(), group.column("root").to_pylist()
        sets = [s.values.to_numpy() for s in group.column("shingles")]
        bins = np.stack([np.frombuffer(b.as_py(), np.uint8) for b in group.column("bins")])
        size = np.array([len(s) for s in sets])
        ids = np.unique(root, return_inverse=True)[1]
        parent = list(range(len(ids)))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        found = []
        for i in range(len(rep) - 1):
            later = slice(i + 1, None)
            alike = (bins[later] == bins[i]).mean(1) >= percent / 100 - SLACK
            fits = np.minimum(size[later], size[i]) * 100 >= np.maximum(size[later], size[i]) * percent
            for j in np.flatnonzero(alike & fits & (ids[later] != ids[i])) + i + 1:
                a, b = top(ids[i]), top(ids[j])
                if a != b:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both * 100 >= (size[i] + size[j] - both) * percent:
                        found.append((rep[i], rep[j]))
                        parent[a] = b
        return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})
    return run
