"""Token ids in directly addressable codes (Brisaboa, Ladra and Navarro, IPM 2013).

An id is split into chunks of eight bits. Level 0 holds the low chunk of every
id; a bit per id tells whether more follows, and level k + 1 holds the next
chunk of those that go on, in order. A rank directory over each bitmap finds
an id's chunk on the next level, so any token is read with a few byte
accesses and no block is decoded.

File layout, little-endian, one file per shard:

    magic "DACT1\\0\\0\\0" | documents u64 | tokens u64 | levels u64
    document numbers i64 x documents | token offsets u64 x (documents + 1)
    per level: chunks u64 | chunk bytes | bitmap (8 bits a byte, low bit first)
               | set bits before every 512 as u64

Shards are rows of a Parquet table (one binary cell each), so any store that
Spark writes to will do, and a lost task's files are never seen.
"""

from __future__ import annotations

import struct
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from worklens.llm.arrays import spans
from worklens.llm.frames import numbered, texts
from worklens.llm.registry import query, table
from worklens.llm.tokenization import encoder, vocabulary
from worklens.session import materialize

MAGIC = b"DACT1\0\0\0"
BLOCK = 512  # bits between two entries of a rank directory
#: A shard is closed at the first document that takes it over this many bytes of text.
SHARD_BYTES = 2_000_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


def write_shard(documents: list[int], ids: list[np.ndarray]) -> bytes:
    """One file of the ids of several documents."""
    sizes = np.array([len(x) for x in ids], np.int64)
    rest = np.concatenate(ids).astype(np.uint32) if len(ids) else np.zeros(0, np.uint32)
    levels = []
    while True:
        on = rest > 0xFF
        bitmap = np.packbits(on, bitorder="little")
        counts = np.add.reduceat(_BITS[bitmap], np.arange(0, len(bitmap), BLOCK // 8)) if len(bitmap) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(counts)])[:-1] if len(counts) else counts
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bitmap.tobytes() + ranks.astype("<u8").tobytes())
        if not on.any():
            break
        rest = rest[on] >> 8
    head = MAGIC + struct.pack("<QQQ", len(ids), int(sizes.sum()), len(levels))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    return head + np.array(documents, "<i8").tobytes() + offsets.tobytes() + b"".join(levels)


class Shard:
    """A file read back: any token alone, or all of them."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_tokens, n_levels = struct.unpack_from("<QQQ", data, 8)
        at = 32
        self.documents = np.frombuffer(data, "<i8", n_docs, at)
        at += 8 * n_docs
        self.offsets = np.frombuffer(data, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bitmap = np.frombuffer(data, np.uint8, -(-n // 8), at)
            at += len(bitmap)
            ranks = np.frombuffer(data, "<u8", -(-n // BLOCK), at)
            at += 8 * len(ranks)
            self.levels.append((chunks, bitmap, ranks))

    def token(self, i: int) -> int:
        """The i-th id of the file."""
        value = 0
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            byte, bit = divmod(i, 8)
            if not bitmap[byte] >> bit & 1:
                return value
            block = i // BLOCK
            i = int(ranks[block]) + int(_BITS[bitmap[block * BLOCK // 8 : byte]].sum()) + int(_BITS[int(bitmap[byte]) & ((1 << bit) - 1)])
        raise ValueError("a code goes on past the last level")

    def tokens(self) -> np.ndarray:
        """All ids of the file."""
        value = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            on = np.unpackbits(bitmap, bitorder="little")[: len(chunks)].astype(bool)
            whole = chunks.astype(np.uint32)
            whole[on] |= value << np.uint32(8)
            value = whole
        return value


SHARDS = "range int, shard int, documents long, tokens long, file binary"


def write(docs: DataFrame, path: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes all documents in ascending doc_id order; returns the table of files.

    A missing or empty text gives the end id alone. Documents that share a
    number stand in order of a hash of their text; those without a number come
    first. The files' order is (range, shard).
    """

    def encode(batches):
        tokens, part, shard = encoder(path), TaskContext.get().partitionId(), 0
        documents, ids, size = [], [], 0

        def full():
            return pd.DataFrame({"range": [part], "shard": [shard], "documents": [len(ids)], "tokens": [sum(map(len, ids))], "file": [write_shard(documents, ids)]})

        for batch in batches:
            rows = batch["text"].tolist()
            numbers = batch["doc_id"].tolist()
            for some in spans([len(t) for t in rows], 500_000):
                for doc, text, got in zip(numbers[some], rows[some], tokens.encode_many(rows[some]), strict=True):
                    documents.append(doc)
                    ids.append(np.append(got, np.uint32(end_id)))
                    size += len(text)
                    if size >= shard_bytes:
                        yield full()
                        documents, ids, size, shard = [], [], 0, shard + 1
        if ids:
            yield full()

    rows = texts(docs).select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("_key"), "doc_id", "text")
    ordered = rows.repartitionByRange("_key").sortWithinPartitions("_key").drop("_key")
    return materialize(ordered.mapInPandas(encode, SHARDS), "token-files")


def starts(shards: DataFrame) -> DataFrame:
    """(range, shard, start): ids in all files before each file.

    Files are summed inside their range; the driver adds up one number per
    range, of which there are as many as shuffle partitions.
    """
    totals = sorted((r["range"], r["n"]) for r in shards.groupBy("range").agg(F.sum("tokens").alias("n")).collect())
    before, rows = 0, []
    for part, n in totals:
        rows.append((part, before))
        before += n
    base = shards.sparkSession.createDataFrame(rows, "range int, before long")
    within = F.sum("tokens").over(W.partitionBy("range").orderBy("shard")) - F.col("tokens")
    return shards.select("range", "shard", within.alias("start")).join(base, "range").select("range", "shard", (F.col("start") + F.col("before")).alias("start"))


def read(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def decode(batches):
        for batch in batches:
            for data, base in zip(batch["file"], batch["start"], strict=True):
                shard = Shard(data)
                raw, edge = shard.tokens().astype("<u4").tobytes(), shard.offsets
                yield pd.DataFrame(
                    {
                        "doc_id": shard.documents,
                        "start": base + edge[:-1],
                        "n_tokens": np.diff(edge),
                        "ids_crc32": [crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)],
                    }
                )

    placed = shards.select("range", "shard", "file").join(starts(shards), ["range", "shard"])
    return numbered(placed.mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long"))


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and ids, read back from the files."""
    return read(write(table(spark, sf_dir, "documents"), vocabulary()))
