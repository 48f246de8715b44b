"""Best-fit packing of documents into training sequences by the sum-of-squares rule.

For every gap g, N(g) counts the open sequences with g tokens of room. A piece
goes into the open sequence after which the sum of N(g)^2 is smallest (Csirik
et al., J. ACM 2006), and into a new one only where none has room. Gaps stay
evenly used, so a later piece nearly always finds a sequence it fills. Pieces
come longest first; that and the last rule matter when few pieces are packed.

The rule looks at one piece after another, so pieces are dealt by a hash into
groups of bounded size, each packed by one task; a group loses at most the few
sequences that are open at its end. Only (document, piece, length) is dealt;
ids stay where they were made.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.llm.arrays import spans
from worklens.llm.frames import NO_NUMBER, numbered, texts
from worklens.llm.registry import query, table
from worklens.llm.tokenization import encoder, vocabulary
from worklens.session import materialize

LENGTH = 2048
#: Pieces packed together by one task.
GROUP_PIECES = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, the short rest first."""
    rest = n % length
    edges = ([0] if rest else []) + list(range(rest, n + 1, length))
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def pieces(docs: DataFrame, path: str, end_id: int = 0, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document, at most ``length`` ids each, with the crc32 of their ids.

    ``keep_ids`` adds the ids (little-endian unsigned 32-bit). A missing or
    empty text is one piece that holds the end id alone. Equal rows give equal
    pieces, one set each.
    """
    from zlib import crc32

    def encode(batches):
        for batch in batches:
            tokens = encoder(path)
            out = defaultdict(list)
            rows, ids = batch["text"].tolist(), batch["doc_id"].tolist()
            for part in spans([len(t) for t in rows]):
                for doc, got in zip(ids[part], tokens.encode_many(rows[part]), strict=True):
                    raw = got.tobytes() + int(end_id).to_bytes(4, "little")
                    for k, (a, n) in enumerate(cut(len(raw) // 4, length)):
                        some = raw[4 * a : 4 * (a + n)]
                        out["doc_id"].append(doc)
                        out["piece"].append(k)
                        out["start"].append(a)
                        out["length"].append(n)
                        out["ids_crc32"].append(crc32(some))
                        if keep_ids:
                            out["ids"].append(some)
            if out:
                yield pd.DataFrame(out)

    schema = PIECES + (", ids binary" if keep_ids else "")
    return numbered(texts(docs).mapInPandas(encode, schema))


def sum_of_squares(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece, in the order given, by the sum-of-squares rule.

    Moving one sequence from gap g to g - n changes the sum of squares by
    2 (N(g-n) - N(g)) + 2 (by one less where nothing is closed or opened);
    gaps of 0 and whole sequences do not count. Ties go to the smallest gap.
    """
    room = np.zeros(capacity + 1, np.int64)  # N(g) for 0 < g < capacity
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        # From gap g (n <= g < capacity): leaves N(g), enters N(g-n) unless g == n.
        gap = None
        if n < capacity:
            gaps = room[n:capacity]
            change = 2 * (room[: capacity - n] - gaps) + 2
            change[0] = 1 - 2 * gaps[0]  # closes a sequence
            change[gaps == 0] = np.iinfo(np.int64).max
            at = int(change.argmin())
            if gaps[at]:
                gap = at + n
        if gap is None:
            bin_, gap = len(used), capacity
            used.append(0)
        else:
            bin_ = open_at[gap].pop()
            room[gap] -= 1
        where[i], offset[i] = bin_, used[bin_]
        used[bin_] += n
        if 0 < (left := gap - n):
            room[left] += 1
            open_at[left].append(bin_)
    return where, offset


def pack(table_: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to (doc_id, piece, length, ...) rows.

    Groups are dealt by a hash of the row and its place in the table, so every
    group sees the same mix of lengths and rows that repeat are placed once
    each. An empty table gives no rows. Within a group pieces go from long to
    short, those of one length by hash.
    """
    total = table_.count()
    groups = max(1, -(-total // group_pieces))
    dealt = table_.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_NUMBER)))
    dealt = dealt.withColumn("_hash", F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_group", F.pmod("_hash", F.lit(groups)))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = frame["length"].to_numpy()
        order = np.lexsort((frame["_hash"].to_numpy(), -sizes))
        frame = frame.iloc[order]
        where, offset = sum_of_squares(sizes[order], length)
        frame = frame.assign(sequence_id=int(frame["_group"].iloc[0]) + where * groups, offset=offset)
        return frame.drop(columns=["_hash", "_group"])

    schema = T.StructType([*table_.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered(dealt.groupBy("_group").applyInPandas(place, schema))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and packed into sequences of 2048 tokens."""
    cut_ = materialize(pieces(table(spark, sf_dir, "documents"), vocabulary()), "pieces")
    return pack(cut_)
