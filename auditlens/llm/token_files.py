"""Token files with shuffled byte or bit planes (operator 2).

File format (Parquet, one row per chunk, so any store that Spark writes to
works): a chunk holds whole documents in ascending doc_id order.  Its ids
(unsigned 32 bit) are cut into blocks of ``BLOCK`` ids; a block is transposed
into 4 byte planes or 32 bit planes, and every plane is compressed with
zstandard on its own.  ``plane_bytes`` lists the compressed sizes of all
planes, which makes the chunk index: with ``first`` and ``n_ids`` it locates
any id without decompressing what stands before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlens.llm.common import ready, scratch
from auditlens.llm.tokenizing import DEFAULT_TOKENIZER, encoder, tokenizer_path

END_ID = 2
#: Ids of one block; ids after which a chunk is closed (at the next document end).
BLOCK, CHUNK = 1 << 16, 1 << 19
#: Characters of the text by which texts of one id are dealt.
RANGE_CHARS = 64
PLANES = {"byte": 4, "bit": 32}

CHUNK_SCHEMA = ("shard int, chunk int, first long, n_ids long, block int, planes string, plane_bytes array<int>, "
                "doc_id array<long>, doc_ids array<long>, payload binary")


def split_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """A block of ids as planes, least significant first."""
    rows = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [rows[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def join_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    """The ids of a block from its planes."""
    if planes == "byte":
        rows = np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts], axis=1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


def pack_chunk(ids: np.ndarray, planes: str = "byte", block: int = BLOCK, level: int = 3) -> tuple[bytes, list[int]]:
    """(payload, compressed size of every plane of every block)."""
    c = zstandard.ZstdCompressor(level=level)
    parts = [c.compress(p) for i in range(0, len(ids), block) for p in split_planes(ids[i:i + block], planes)]
    return b"".join(parts), [len(p) for p in parts]


def unpack_chunk(payload: bytes, sizes: list[int], n_ids: int, planes: str = "byte", block: int = BLOCK) -> np.ndarray:
    """The ids of a chunk."""
    d, k, out, at = zstandard.ZstdDecompressor(), PLANES[planes], [], 0
    for b in range(0, len(sizes), k):
        parts = []
        for size in sizes[b:b + k]:
            parts.append(d.decompress(payload[at:at + size]))
            at += size
        out.append(join_planes(parts, min(block, n_ids - b // k * block), planes))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def write_token_files(docs: DataFrame, path: str, tokenizer: str = DEFAULT_TOKENIZER, planes: str = "byte",
                      block: int = BLOCK, chunk: int = CHUNK, end_id: int = END_ID) -> None:
    """Encode (doc_id, text) and write the token files to ``path``.

    Documents are range-partitioned on doc_id and the start of the text; partition k writes shard k, so
    shards and chunks are in ascending doc_id order (nulls first; equal ids by
    text).  A null or empty text has only the end id.  An empty table writes
    no chunk.  Tasks stream: memory is one Arrow batch plus one chunk (a
    longer document makes a longer chunk); a lost task is simply run again.
    """
    if planes not in PLANES:
        raise ValueError(f"planes must be one of {sorted(PLANES)}")
    ready(docs.sparkSession)
    where = tokenizer_path(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard, enc = TaskContext.get().partitionId(), encoder(where)
        ids, tokens, parts, held, number, first = [], [], [], 0, 0, 0

        def close():
            nonlocal ids, tokens, parts, held, number, first
            payload, sizes = pack_chunk(np.concatenate(parts), planes, block)
            row = {"shard": shard, "chunk": number, "first": first, "n_ids": held, "block": block, "planes": planes,
                   "plane_bytes": sizes, "doc_id": ids, "doc_ids": tokens, "payload": payload}
            number, first = number + 1, first + held
            ids, tokens, parts, held = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_arrow_schema())

        for batch in batches:
            docs, at = batch.column(0).to_pylist(), 0
            for got, bounds in enc.encode_flat(batch.column(1)):
                # the end id behind each text
                got, counts = np.insert(got, bounds[1:], end_id), np.diff(bounds) + 1
                ends, lo = np.cumsum(counts), 0
                while lo < len(counts):
                    # whole documents until the chunk is full
                    before = ends[lo - 1] if lo else 0
                    hi = min(len(counts), int(np.searchsorted(ends, before + chunk - held)) + 1)
                    ids += docs[at + lo:at + hi]
                    tokens += counts[lo:hi].tolist()
                    parts.append(got[before:ends[hi - 1]])
                    held += int(ends[hi - 1] - before)
                    lo = hi
                    if held >= chunk:
                        yield close()
                at += len(counts)
        if ids:
            yield close()

    # a start of the text in the range, so that many texts of one id (or of none) are several shards
    rows = (docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, RANGE_CHARS).asc_nulls_first())
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"))
    rows.mapInArrow(encode, CHUNK_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def _arrow_schema() -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("block", pa.int32()),
                      ("planes", pa.string()), ("plane_bytes", pa.list_(pa.int32())), ("doc_id", pa.list_(pa.int64())),
                      ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """Where every chunk stands: shard, chunk, global first id, ids, plane sizes.  Payloads are not read."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path).drop("payload", "doc_id", "doc_ids")
    return chunks.join(shard_starts(spark, path), "shard").withColumn("first", F.col("first") + F.col("shard_start")).drop("shard_start")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each shard: a running sum over one row per shard."""
    totals = spark.read.schema(CHUNK_SCHEMA).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("shard_start"))


def read_token_files(spark: SparkSession, path: str, digest_only: bool = True) -> DataFrame:
    """Per document from the files: doc_id, start (ids before it over all files), n_tokens, ids_crc32 and, if wanted, ids.

    Chunks hold whole documents, so they decode in parallel without a shuffle.
    """
    ready(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack_chunk(r["payload"], r["plane_bytes"], r["n_ids"], r["planes"], r["block"])
                ends = np.cumsum(r["doc_ids"], dtype=np.int64)
                starts = ends - np.asarray(r["doc_ids"], np.int64)
                cols = [pa.array([r["shard"]] * len(ends), pa.int32()), pa.array(r["doc_id"], pa.int64()), pa.array(starts + r["first"]),
                        pa.array(r["doc_ids"], pa.int64()),
                        pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], pa.int64())]
                names = ["shard", "doc_id", "start", "n_tokens", "ids_crc32"]
                if not digest_only:
                    cols.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if not digest_only else "")
    docs = spark.read.schema(CHUNK_SCHEMA).parquet(path).mapInArrow(decode, schema)
    docs = docs.join(shard_starts(spark, path), "shard")
    return docs.withColumn("start", F.col("start") + F.col("shard_start")).drop("shard", "shard_start")


def token_file_digest(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, planes: str = "byte") -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read every document back from them."""
    spark = docs.sparkSession
    path = scratch(spark, "token-files")
    write_token_files(docs, path, tokenizer, planes)
    return read_token_files(spark, path)
