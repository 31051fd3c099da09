"""Exact n-gram Jaccard join of documents by size-banded tiles with bitmap signatures.

1. Documents with equal shingle sets are one class; the member with the smallest doc_id stands for it.
2. Which classes can meet: all shingles have one global order, those common in the corpus last. Two sets that link share a
   shingle among the first s - ceil(percent * s / 100) + 1 of each. Classes that share one are paired where their sizes, the places of the
   shingle and their bitmaps (4.) allow a link. Common shingles give chains of classes in place of pairs. A link never leaves a
   connected component of these pairs, a cloud. This step has no false negatives; what it lets through is compared below.
3. A cloud's classes fall into bands of set size so that links join equal or neighbouring bands only. Bands are dealt into
   blocks of bounded rows and bytes, and two blocks are a tile: every pair of a cloud is met in exactly one tile.
4. In a tile each set becomes a bitmap of hashed positions, wider in tiles of larger sets. Every differing bit stands for at least
   one shingle that only one set has, so the overlap is at most (s1 + s2 - differing bits) / 2; pairs below the needed overlap
   end here. The others are decided by the size of the intersection of their sorted arrays.
5. A tile returns links per class (counted in documents) and one spanning link per class, never its pairs. Components of
   the spanning links are those of all links.

Cost: texts are read three times (class keys; leading shingles; sets of classes in clouds, the one join that moves texts). About a
fifth of the shingles, of each class once per task, go through one shuffle as (hash, class, size, place). Common shingles do not: a task chains
its own documents and passes on one of them per size group. Shingles and classes are told apart by 64-bit and 128-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import Cache, Scratch, arrow_rows
from tagweave.llm.components import components
from tagweave.llm.neardup import shingle_set

BLOCK_ROWS = 1024
BLOCK_SHINGLES = 2_000_000
BATCH_SHINGLES = 4_000_000
COMMON, MAX_COMMON = 64, 1_000_000
PAIRED = 1024  # shingles of so many classes at most give pairs, others chains
MIN_BITS, MAX_BITS = 256, 1 << 16
_KEYED = "doc_id long, n_shingles long, k1 long, k2 long"
_SETS = "k1 long, k2 long, rep long, copies long, cloud long, shingles array<long>"
_SETS_NAMES = [c.split()[0] for c in _SETS.split(", ")]
_TILE = "struct<tile_cloud:bigint,band:int,kind:int,i:int,j:int,side:int>"


def jaccard_join(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links between documents with 100 * intersection >= percent * union of their shingle sets, and what they connect.

    Returns per row of `docs`: doc_id, n_shingles (set size), n_links (other rows that this one links with, equal sets
    included) and component_id (the smallest doc_id that links reach). Words are runs of other than ASCII white space with A-Z
    lower-cased; a text of fewer words than a shingle is one shingle.

    A document without words, or a null text, has the empty set and links with nothing. Rows of one doc_id are one document: they
    share a component, and each row gives a result with its own links, among which its other rows count too. Rows with a null
    doc_id link with nothing, have no links and a null component_id. Other columns are ignored; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "tilejoin")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    keyed = scratch.write(rows.mapInArrow(_class_keys(shingle_words), f"{_KEYED}, common array<long>, counts array<int>"), "keyed")
    members = keyed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = scratch.write(members.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"),
                                                            F.count(F.lit(1)).alias("copies")), "classes")
    leading = scratch.write(rows.where("doc_id IS NOT NULL").mapInArrow(
        _leading(shingle_words, percent, _common_shingles(keyed)),
        "node long, size int, keys array<long>, groups array<long>, centres array<long>, bitmap binary"), "leading")
    chains = scratch.write(_chains(leading, percent, scratch), "chains")
    scratch.drop("leading", "pairs")
    roots = components(chains, scratch, "clouds")
    clouds = (roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
              .select(F.col("node").alias("k1"), F.col("root").alias("cloud")))

    placed = _place(scratch.write(classes.join(clouds, "k1"), "members"), percent)
    sets = (rows.join(placed.withColumnRenamed("rep", "doc_id"), "doc_id")
            .mapInArrow(_sets(shingle_words), f"{_SETS}, tiles array<{_TILE}>").select("*", F.explode("tiles").alias("tile")))
    links = scratch.write(sets.select("tile.*", *_SETS_NAMES).groupBy("tile_cloud", "band", "kind", "i", "j").applyInArrow(
        _compare(percent), "k1 long, k2 long, u long, v long, n_links long"), "links")

    # A doc_id with several texts ties their classes together.
    key = F.struct("k1", "k2")
    several = members.groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("doc_id")
    ties = (members.join(several, "doc_id", "left_semi").join(classes, ["k1", "k2"])
            .select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    root = components(links.select("u", "v").unionByName(ties), scratch, "linked")
    named = (classes.join(root.withColumnRenamed("node", "rep"), "rep", "left")
             .join(links.groupBy("k1", "k2").agg(F.sum("n_links").alias("n_links")), ["k1", "k2"], "left")
             .select("k1", "k2", F.coalesce("root", "rep").alias("component_id"),
                     (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = keyed.where("n_shingles IS NOT NULL").join(named, ["k1", "k2"], "left")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
                      F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"))


def _common_shingles(keyed: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that are common in the corpus.

    The list only says which shingles come last in the order, so no link depends on it. Counted are all documents, but in each
    batch only shingles of two classes or more. An entry has COMMON classes at least, or the smallest power of two times that for which
    the list has at most MAX_COMMON entries."""
    held = (keyed.where("common IS NOT NULL").select(F.explode(F.arrays_zip("common", "counts")).alias("c"))
            .groupBy("c.common").agg(F.sum("c.counts").alias("n")).where(F.col("n") >= COMMON))
    level = F.floor(F.log2(F.col("n") / COMMON)).cast("int")
    least, entries = 0, 0
    for r in held.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        entries += r["count"]
        least = r["level"]
        if entries > MAX_COMMON:
            least = r["level"] + 1
            break
    found = held.where(F.col("n") >= COMMON << least).select("common").toArrow()
    return np.sort(found.column("common").to_numpy().astype(np.int64).view(np.uint64))


def _class_key(shingles: np.ndarray) -> list[int]:
    return np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64).tolist()


def _class_keys(k: int):
    """A row per document, and one with the repeated shingles for every BATCH_SHINGLES shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                        ("common", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])

    def repeated(seen: dict) -> tuple:
        value, count = np.unique(np.concatenate(list(seen.values())), return_counts=True)
        return None, None, None, None, value[count > 1].view(np.int64), count[count > 1].astype(np.int32)

    def rows(batches):
        cache, seen, size = Cache(xxhash.xxh3_64_digest), {}, 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                s = shingle_set(cache, text.as_py(), k)
                if not len(s):
                    yield doc.as_py(), 0, None, None, None, None
                    continue
                k1, k2 = _class_key(s)
                yield doc.as_py(), len(s), k1, k2, None, None
                if (k1, k2) not in seen:
                    seen[k1, k2] = s
                    size += len(s)
                if size > BATCH_SHINGLES:
                    yield repeated(seen)
                    seen, size = {}, 0
            cache.trim()
        if seen:
            yield repeated(seen)

    return lambda batches: arrow_rows(schema, rows(batches), weigh=lambda r: 0 if r[4] is None else 12 * len(r[4]))


def leading_shingles(shingles: np.ndarray, percent: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of a sorted set in the order of all shingles, so many that two sets that link have one of them in common: those
    that are not common in the corpus, in their places, and the common ones after them."""
    n = len(shingles) + percent * len(shingles) // -100 + 1
    if not len(common):
        return shingles[:n], shingles[:0]
    late = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
    early = shingles[~late][:n]
    return early, shingles[late][:n - len(early)]


def _band(size, percent: int):
    """Sizes that can link are in equal or neighbouring bands: their ratio is a little above 100 / percent."""
    return np.floor(np.log(size) / np.log(100.0 / percent * 1.001))


def _leading(k: int, percent: int, common: np.ndarray):
    """Per task and class: its leading shingles (`keys`, in their places), its bitmap, and for common ones the classes met first in
    this task in the same size group (`centres`), or the group itself where this class is the first (`groups`)."""
    schema = pa.schema([("node", pa.int64()), ("size", pa.int32())] + [(c, pa.list_(pa.int64())) for c in ("keys", "groups", "centres")]
                       + [("bitmap", pa.binary())])

    def rows(batches):
        cache, seen, first = Cache(xxhash.xxh3_64_digest), set(), {}
        for batch in batches:
            for text in batch.column("text"):
                s = shingle_set(cache, text.as_py(), k)
                node = _class_key(s)[0] if len(s) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                early, late = leading_shingles(s, percent, common)
                groups, centres = [], set()
                band = int(_band(len(s), percent))
                for key in late.view(np.int64).tolist():
                    for group in ((key, band), (key, band + 1)):
                        centre = first.setdefault(group, node)
                        if centre == node:
                            groups.append(xxhash.xxh3_64_intdigest(b"%d %d" % group) - (1 << 63))
                        else:
                            centres.add(centre)
                yield node, len(s), early.view(np.int64), groups, list(centres), bitmap(s, width(len(s))).tobytes()
            cache.trim()

    return lambda batches: arrow_rows(schema, rows(batches), weigh=lambda r: 8 * (len(r[2]) + len(r[3]) + len(r[4])) + len(r[5]))


def _chains(leading: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of classes whose connected components hold every link."""
    keys = leading.select("node", "size", F.posexplode("keys").alias("place", "key"))
    groups = leading.select("node", F.lit(-1).alias("size"), F.lit(0).alias("place"), F.explode("groups").alias("key"))
    pairs = scratch.write(keys.unionByName(groups).repartition("key").sortWithinPartitions("key", "size", "node")
                          .mapInArrow(_pairs(percent), "u long, v long, tested boolean").distinct(), "pairs")
    of = {c: leading.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("bitmap").alias(f"bitmap_{c}"))
          .dropDuplicates([c]) for c in "uv"}
    near = pairs.where("tested").join(of["u"], "u").join(of["v"], "v").mapInArrow(_near(percent), "u long, v long")
    centres = leading.select(F.col("node").alias("u"), F.explode("centres").alias("v"))
    return near.unionByName(pairs.where("NOT tested").select("u", "v")).unionByName(centres.distinct())


def _pairs(percent: int):
    """Pairs of classes that share a shingle, from rows in the order of shingles and sizes.

    Up to PAIRED classes are tested pair by pair: with the shingle at places i and j, as the first common one, the overlap is at most
    min(s1 - i, s2 - j). More are chained while the sizes of neighbours allow a link: whatever lies between two sizes that can
    link can link with both. Rows of size -1, which lead a size group of a common shingle in some task, are chained without a test."""
    def pairs(key, node, size, place):
        run = np.r_[0, np.cumsum(key[1:] != key[:-1])]
        many = np.bincount(run)[run] > PAIRED
        at, out = np.arange(len(key)), []
        for step in range(1, PAIRED):
            at = at[at >= step]
            at = at[key[at] == key[at - step]]
            if not len(at):
                break
            back = at - step
            total = percent * (size[at] + size[back])
            fits = np.minimum(size[at] - place[at], size[back] - place[back]) * (100 + percent) >= total
            chained = many[at] | (size[at] < 0)
            keep = np.where(chained, (step == 1) & ((size[at] < 0) | (size[back] * 100 >= size[at] * percent)), fits)
            keep &= node[at] != node[back]
            a, b = node[at[keep]], node[back[keep]]
            out.append(np.stack([np.maximum(a, b), np.minimum(a, b), ~chained[keep]], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def run(batches):
        held = None
        for batch in batches:
            new = [batch.column(c).to_numpy().astype(np.int64) for c in ("key", "node", "size", "place")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
        if held is not None:
            yield held

    def found(batches):
        for part in run(batches):
            if len(part[0]):
                u, v, tested = pairs(*part).T
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(tested.astype(bool))], names=["u", "v", "tested"])
    return found


def _near(percent: int):
    """The pairs whose bitmaps allow a link."""
    def run(batches):
        for batch in batches:
            size = [batch.column(f"size_{c}").to_numpy().astype(np.int64) for c in "uv"]
            total = size[0] + size[1]
            apart = np.array([differing(*(np.frombuffer(b.as_py(), np.uint64) for b in pair))
                              for pair in zip(batch.column("bitmap_u"), batch.column("bitmap_v"))], np.int64)
            keep = pa.array((total - apart) // 2 * (100 + percent) >= percent * total)
            yield batch.select(["u", "v"]).filter(keep)
    return run


def _sets(k: int):
    def run(batches):
        cache = Cache(xxhash.xxh3_64_digest)
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            held, sets, size = [], [], 0
            for i, text in enumerate(batch.column("text")):
                s = shingle_set(cache, text.as_py(), k)
                if len(s) and _class_key(s) == [k1[i], k2[i]]:
                    held.append(i)
                    sets.append(s)
                    size += len(s)
                if held and (size > BLOCK_SHINGLES or i == len(batch) - 1):
                    part = batch.take(pa.array(held))
                    ends = pa.array(np.r_[0, np.cumsum([len(x) for x in sets])], pa.int32())
                    shingles = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("k1"), part.column("k2"), part.column("doc_id"), part.column("copies"), part.column("cloud"), shingles,
                         part.column("tiles")], names=_SETS_NAMES + ["tiles"])
                    held, sets, size = [], [], 0
            cache.trim()
    return run


def _place(members: DataFrame, percent: int) -> DataFrame:
    """The tiles of every class, as an array.

    kind 0 compares a block with itself, 1 two blocks of a band, 2 a block of a band with one of the next band, and 3 holds
    whole small clouds (tile_cloud -1, many in one tile). `side` says whether a class is in the first or second block.
    """
    base = float(np.log(100.0 / percent * 1.001))
    banded = members.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / F.lit(base)).cast("int"))
    per_cloud = banded.groupBy("cloud").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("shingles"))
    per_cloud = per_cloud.select("cloud", "shingles", ((F.col("rows") <= BLOCK_ROWS) & (F.col("shingles") <= BLOCK_SHINGLES)).alias("small"))
    bins = (per_cloud.where("small").agg(F.sum("shingles")).first()[0] or 0) // BLOCK_SHINGLES + 1

    per_band = (banded.join(per_cloud.where("NOT small").select("cloud"), "cloud").groupBy("cloud", "band")
                .agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    own, above, below = (per_band.select("cloud", (F.col("band") + step).alias("band"), F.col("blocks").alias(name))
                         for step, name in ((0, "own"), (-1, "above"), (1, "below")))
    grid = own.join(above, ["cloud", "band"], "left").join(below, ["cloud", "band"], "left").na.fill(0)

    def tile(cloud, band, kind, i, j, side) -> Column:
        fields = dict(tile_cloud=cloud, band=band, kind=kind, i=i, j=j, side=side)
        made = F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(name) for name, v in fields.items()])
        return made.cast(_TILE)

    def each(n: str, make) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1), make)

    cloud, band, at, none = F.col("cloud"), F.col("band"), F.col("at"), F.array().cast(f"array<{_TILE}>")
    inside = each("own", lambda o: F.when(o == at, tile(cloud, band, 0, at, at, 0)).otherwise(
        tile(cloud, band, 1, F.least(at, o), F.greatest(at, o), at > o)))
    up = F.when(F.col("above") > 0, each("above", lambda o: tile(cloud, band, 2, at, o, 0))).otherwise(none)
    down = F.when(F.col("below") > 0, each("below", lambda o: tile(cloud, band - 1, 2, o, at, 1))).otherwise(none)
    columns = ["rep", "k1", "k2", "copies", "cloud"]
    large = (banded.join(grid, ["cloud", "band"]).withColumn("at", F.pmod(F.xxhash64("k1", "k2"), F.col("own")))
             .select(*columns, F.concat(inside, up, down).alias("tiles")))
    whole = (banded.join(per_cloud.where("small").select("cloud"), "cloud")
             .select(*columns, F.array(tile(-1, 0, 3, F.pmod(F.xxhash64("cloud"), F.lit(bins)), 0, 0)).alias("tiles")))
    return large.unionByName(whole)


def width(size: int) -> int:
    """Bits of the bitmap of a set."""
    return min(MAX_BITS, max(MIN_BITS, 1 << int(2 * size - 1).bit_length()))


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    marks = np.zeros(bits, np.uint8)
    marks[shingles.view(np.uint64) & np.uint64(bits - 1)] = 1
    return np.packbits(marks).view(np.uint64)


def differing(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two bitmaps differ; the wider one is folded."""
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[:len(a) // 2] | a[len(a) // 2:]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


class Block:
    """Sets of one tile with their bitmaps, and their shingles numbered in sorted order."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        bits = width(int(self.size.max()))
        self.bitmaps = np.stack([bitmap(s, bits) for s in sets])
        values, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.ends = np.r_[0, np.cumsum(self.size)]
        self.held = np.zeros(len(values), bool)

    def links(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of `others` that set i links with."""
        total = self.size[others] + self.size[i]
        needed = -(-percent * total // (100 + percent))
        possible = np.minimum(self.size[others], self.size[i]) >= needed
        others, total, needed = others[possible], total[possible], needed[possible]
        apart = np.bitwise_count(self.bitmaps[others] ^ self.bitmaps[i]).sum(1, dtype=np.int64)
        possible = (total - apart) // 2 >= needed
        others, needed = others[possible], needed[possible]
        if not len(others):
            return others
        own = self.flat[self.ends[i]:self.ends[i + 1]]
        self.held[own] = True
        if 4 * len(others) > len(self.size):
            both = np.add.reduceat(self.held[self.flat], self.ends[:-1], dtype=np.int64)[others]
        else:
            both = np.array([np.count_nonzero(self.held[self.flat[self.ends[j]:self.ends[j + 1]]]) for j in others])
        self.held[own] = False
        return others[both >= needed]


def compare_sets(sets: list[np.ndarray], side: np.ndarray | None, copies: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(links of every set counted in copies, the number of its component) over all pairs, or those of different sides."""
    block, n_links, label = Block(sets), np.zeros(len(sets), np.int64), np.arange(len(sets))
    right = None if side is None else np.flatnonzero(side == 1)
    for i in (range(len(sets) - 1) if side is None else np.flatnonzero(side == 0)):
        linked = block.links(i, np.arange(i + 1, len(sets)) if side is None else right, percent)
        if len(linked):
            n_links[i] += copies[linked].sum()
            n_links[linked] += copies[i]
            joined = np.unique(np.r_[label[linked], label[i]])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    return n_links, label


def _compare(percent: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        kind = key[2].as_py()
        cloud, side = group.column("cloud").to_numpy(), group.column("side").to_numpy()
        k1, k2 = group.column("k1").to_numpy(), group.column("k2").to_numpy()
        order = np.lexsort((k2, k1, side, cloud))
        # Of repeated rows of one representative only one takes part.
        new = np.r_[True, (np.diff(cloud[order]) != 0) | (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)]
        order = order[new]
        rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        column = group.column("shingles").combine_chunks()
        ends, values = column.offsets.to_numpy(), column.values.to_numpy()
        out = []
        for part in np.split(order, np.flatnonzero(np.diff(cloud[order])) + 1):
            sets = [values[ends[r]:ends[r + 1]] for r in part]
            n_links, label = compare_sets(sets, side[part] if kind in (1, 2) else None, copies[part], percent)
            low = np.full(len(part), np.iinfo(np.int64).max)
            np.minimum.at(low, label, rep[part])
            hit = np.flatnonzero(n_links)
            out.append((k1[part][hit], k2[part][hit], rep[part][hit], low[label][hit], n_links[hit]))
        return pa.table(dict(zip(("k1", "k2", "u", "v", "n_links"), map(np.concatenate, zip(*out)))))
    return run
