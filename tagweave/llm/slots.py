"""Training-order materialisation: a keyed permutation gives every token sequence its slot in fixed-stride shard files.

1. Texts become token ids once and are cut into sequences of at most `seq_len`, stored in the shared folder. Sequences are
   numbered 0 to n - 1: by stored part, then by place in it. The store fixes the numbering; a resumed run reads it again.
2. A Feistel network over the next even number of bits, walked along its cycle until it lands below n, is a
   permutation of 0 to n - 1 that needs no table and no sort of the whole.
3. Slots are cut into shards of `per_shard` sequences. Some ranges of shards are written at a time: as slots have no gaps, the
   range partition of a row is its shard; a partition is sorted by slot and streamed into a file with one record every `stride` bytes,
   so record i of a shard is at i * stride. A range is complete when its manifest is; a later run skips complete ranges and
   makes others anew. What a folder was made of is written there first, and a run with anything else is refused.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import Scratch, arrow_rows, remove_path

ROUNDS = 4
HEADER = "<qiI"
HEADER_BYTES = struct.calcsize(HEADER)
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DOUBLE, CUT = re.compile(r"\s "), re.compile(r"(?<=\s)(?= )")  # Python's \s holds all that is white space to PATTERN
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of the given sequence numbers: a permutation of range(n) chosen by `key`."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng(key).integers(0, 1 << 63, size=ROUNDS, dtype=np.uint64)
    out = np.asarray(index).astype(np.uint64)
    walk = np.ones(len(out), bool)
    while walk.any():
        left, right = out[walk] >> half, out[walk] & mask
        for k in keys:
            h = (right + k) * _A
            h = (h ^ (h >> np.uint64(29))) * _B
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        out[walk] = (left << half) | right
        walk &= out >= np.uint64(n)
    return out.astype(np.int64)


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """A byte-level BPE of a vocabulary file of `base64 rank` lines."""
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokens:
    """Token ids of texts as little-endian 16-bit numbers.

    Every word is encoded with the one space before it, and no token holds a space that follows other white space: texts are cut
    before such spaces. Elsewhere PATTERN itself starts anew at each space, so what lies between two cuts is encoded at once.
    """

    def __init__(self, path: str):
        self.encode = encoder(path).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        parts = CUT.split(text) if DOUBLE.search(text) else [text]
        return b"".join([np.array(self.encode(p), "<u2").tobytes() for p in parts])


def decode(ids: bytes, path: str = TOKENIZER) -> str:
    return encoder(path).decode(np.frombuffer(ids, "<u2").tolist())


def materialise(docs: DataFrame, path: str, key: int = 1, seq_len: int = 256, per_shard: int = 32_768, passes: int = 4,
                tokenizer: str = TOKENIZER, pad: int = 50_256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the sequences of `docs` below `path` (a URI all executors reach) in training order; return the manifest.

    Manifest rows: doc_id, piece, n_tokens, slot, shard, offset (bytes) and crc (of the token bytes). Shard files are
    `path`/shards/shard-<number>.bin; a record is doc_id (int64), piece (int32), n_tokens (uint32) and seq_len token ids
    (uint16), the rest filled with `pad`. Read back with `read_shard`. A null doc_id is stored as -2 ** 63.

    A run that finds the token store of `path` complete uses it, and skips ranges whose manifest is complete. Incomplete parts, as a
    lost run leaves them, are written again. ValueError if `path` was begun with other documents or parameters.
    Null and empty texts have no sequences. Repeated rows are sequences of their own. Other columns are ignored; no rows
    give no shards and an empty manifest. The vocabulary must have at most 65 536 ids.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "slots")
    scratch.root = path
    _same_run(docs, path, id_col, text_col, key=key, seq_len=seq_len, per_shard=per_shard, passes=passes, tokenizer=os.path.basename(tokenizer), pad=pad)
    if not _exists(spark, f"{path}/tokens/_SUCCESS"):
        remove_path(spark, f"{path}/tokens")
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        scratch.write(rows.mapInArrow(_tokenise(tokenizer, seq_len), _STORE), "tokens", "zstd")
    store = spark.read.schema(_STORE).parquet(f"{path}/tokens")
    # One row a stored part, so at most as many rows as the first job had tasks.
    parts = store.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    base = parts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                                           F.lit(0)).alias("base"))
    n = store.count()
    shards = -(-n // per_shard)

    @F.pandas_udf("long")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), n, key))

    slot_of = slot_of.asNondeterministic()  # so that the filter on shards reads the column and does not compute it again
    placed = (store.join(F.broadcast(base), "part")
              .withColumn("slot", slot_of(F.col("base") + F.col("row"))).drop("part", "row", "base")
              .withColumn("shard", F.floor(F.col("slot") / per_shard).cast("long")))
    step = max(1, -(-shards // passes))
    for lo in range(0, shards, step):
        if not _exists(spark, f"{path}/manifest/from={lo}/_SUCCESS"):
            remove_path(spark, f"{path}/manifest/from={lo}")
            mine = placed.where((F.col("shard") >= lo) & (F.col("shard") < lo + step))
            dealt = (mine.repartitionById(min(step, shards - lo), (F.col("shard") - lo).cast("int"))
                     .sortWithinPartitions("slot"))
            scratch.write(dealt.mapInArrow(_write_shards(path, seq_len, per_shard, pad), _MANIFEST), f"manifest/from={lo}")
    ready = [f"{path}/manifest/from={lo}" for lo in range(0, shards, step)]
    return spark.read.schema(_MANIFEST).parquet(*ready) if ready else spark.createDataFrame([], _MANIFEST)


_STORE = "doc_id long, piece int, n_tokens int, tokens binary, part long, row long"
_MANIFEST = "doc_id long, piece int, n_tokens int, slot long, shard long, offset long, crc long"


def _exists(spark, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def _same_run(docs: DataFrame, path: str, id_col: str, text_col: str, **parameters) -> None:
    """Write what the run is made of to `path`, or compare with what is there."""
    spark = docs.sparkSession
    marks = docs.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).cast("decimal(38,0)"))).first()
    mine = json.dumps({**parameters, "rows": marks[0], "sum": str(marks[1])}, sort_keys=True)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/parameters.json")
    system = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(target):
        if system.exists(target.getParent()) and len(system.listStatus(target.getParent())):
            raise ValueError(f"{path} is not empty and does not say what it was made of")
        draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/parameters.{uuid.uuid4().hex}")
        stream = system.create(draft, True)
        try:
            stream.write(bytearray(mine.encode()))
        finally:
            stream.close()
        system.rename(draft, target)
        return
    stream = system.open(target)
    try:
        there = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    if there != mine:
        raise ValueError(f"{path} was begun with {there}, this run has {mine}")


def _tokenise(tokenizer: str, seq_len: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("n_tokens", pa.int32()), ("tokens", pa.binary()),
                        ("part", pa.int64()), ("row", pa.int64())])

    def rows(batches):
        tokens, part, row, width = Tokens(tokenizer), TaskContext.get().partitionId(), 0, 2 * seq_len
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                ids, doc = tokens(text.as_py()), doc.as_py()
                for at in range(0, len(ids), width):
                    cut = ids[at:at + width]
                    yield doc, at // width, len(cut) // 2, cut, part, row
                    row += 1

    return lambda batches: arrow_rows(schema, rows(batches), limit=8192)


def _write_shards(path: str, seq_len: int, per_shard: int, pad: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("n_tokens", pa.int32()), ("slot", pa.int64()),
                        ("shard", pa.int64()), ("offset", pa.int64()), ("crc", pa.int64())])
    filler, stride = np.full(seq_len, pad, "<u2").tobytes(), HEADER_BYTES + 2 * seq_len

    def rows(batches):
        system, folder = _file_system(path)
        system.create_dir(f"{folder}/shards", recursive=True)
        now, out, names = None, None, (None, None)
        for batch in batches:
            for doc, piece, n, ids, slot, shard in zip(*[batch.column(c).to_pylist() for c in (
                    "doc_id", "piece", "n_tokens", "tokens", "slot", "shard")]):
                if shard != now:
                    _close(system, out, names)
                    now, final = shard, f"{folder}/shards/shard-{shard:09d}.bin"
                    names = (f"{final}.{uuid.uuid4().hex}", final)
                    out = system.open_output_stream(names[0])
                out.write(struct.pack(HEADER, -(1 << 63) if doc is None else doc, piece, n) + ids + filler[2 * n:])
                yield doc, piece, n, slot, shard, (slot - shard * per_shard) * stride, zlib.crc32(ids)
        _close(system, out, names)

    return lambda batches: arrow_rows(schema, rows(batches), limit=8192)


def _close(system, out, names) -> None:
    """A shard file gets its name when it is whole, so a task that runs twice leaves one whole file."""
    if out is not None:
        out.close()
        if system.get_file_info(names[1]).type != fs.FileType.NotFound:
            system.delete_file(names[1])
        system.move(*names)


def _file_system(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def read_shard(path: str, shard: int, seq_len: int = 256, start: int = 0):
    """(doc_id, piece, token bytes) of a shard's records in order, from record `start` on."""
    system, folder = _file_system(path)
    stride = HEADER_BYTES + 2 * seq_len
    with system.open_input_file(f"{folder}/shards/shard-{shard:09d}.bin") as f:
        f.seek(start * stride)
        while record := f.read(stride):
            doc, piece, n = struct.unpack_from(HEADER, record)
            yield doc, piece, bytes(record[HEADER_BYTES:HEADER_BYTES + 2 * n])
