"""Line deduplication with a sharded minimal perfect hash.

Distinct line keys of enough documents are spread over shards by hash. Each
shard gets a minimal perfect hash of cascaded bit arrays (Limasset et al., SEA
2017) with three arrays indexed by it: a 64-bit fingerprint, the document
count and the last document. Lines then probe those arrays: a shard's arrays
travel once, followed by the stream of its probes; no line meets the table of
counted lines in a join.

Lines are hashed twice. The first hash picks shard and slot, the second is the
fingerprint, so a line outside the table is told apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.functions.text import bound
from worklens.llm.arrays import mix
from worklens.llm.frames import NO_NUMBER, texts
from worklens.llm.registry import query, table
from worklens.llm.tokenization import forget
from worklens.session import materialize

#: Keys a shard holds on average.
SHARD_KEYS = 100_000
#: Lines that probe a shard on average.
SHARD_PROBES = 200_000
#: Probes of counted lines per copy of a shard: one with frequent lines gets several copies, each with its own stream.
COPY_PROBES = 1_000_000
MIN_CHARS = 20
MIN_DOCS = 3

ARRAYS = ("function", "fingerprint", "docs", "last", "spill")

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class PerfectHash:
    """Minimal perfect hash over distinct unsigned 64-bit keys, gamma bits per key and level."""

    GAMMA = 2

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        seen, depth = 0, 0
        while len(keys):
            size = max(64, self.GAMMA * len(keys))
            slot = self._slot(keys, depth, size)
            taken = np.bincount(slot, minlength=size)
            lone = taken == 1
            self.levels.append((lone, seen + np.concatenate([[0], np.cumsum(lone)])[:-1]))
            seen += int(lone.sum())
            keys, depth = keys[~lone[slot]], depth + 1
        self.size = seen

    @staticmethod
    def _slot(keys: np.ndarray, depth: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(depth * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of every key, -1 where no level claims it; keys outside the set may get any index."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for depth, (lone, rank) in enumerate(self.levels):
            slot = self._slot(keys[left], depth, len(lone))
            hit = lone[slot]
            out[left[hit]] = rank[slot[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def packed(self) -> bytes:
        return b"".join(len(lone).to_bytes(8, "little") + np.packbits(lone).tobytes() for lone, _ in self.levels)

    @classmethod
    def unpacked(cls, data: bytes) -> PerfectHash:
        new, at, seen = cls.__new__(cls), 0, 0
        new.levels = []
        while at < len(data):
            size = int.from_bytes(data[at : at + 8], "little")
            lone = np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at + 8))[:size].astype(bool)
            new.levels.append((lone, seen + np.concatenate([[0], np.cumsum(lone)])[:-1]))
            seen, at = seen + int(lone.sum()), at + 8 + -(-size // 8)
        new.size = seen
        return new


def key(line: Column) -> Column:
    """A line without blanks at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def _hashes(keys: Column) -> tuple[Column, Column]:
    return F.xxhash64(keys), F.xxhash64(keys, F.lit("fingerprint"))


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h, f), once per document and distinct key of at least ``min_chars`` code points."""
    keys = F.array_distinct(F.transform(F.split("text", "\n", -1), key))
    long_enough = docs.select("doc_id", F.explode(F.filter(keys, lambda k: F.char_length(k) >= min_chars)).alias("k"))
    h, f = _hashes(F.col("k"))
    return long_enough.select("doc_id", h.alias("h"), f.alias("f"))


def build_shards(lines: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The shards (shard, data) of all keys in at least ``min_docs`` documents, and their number."""
    # A document number that occurs twice stands for one document.
    counted = (
        lines.distinct()
        .groupBy("h", "f")
        .agg(F.sum((F.col("doc_id") != NO_NUMBER).cast("long")).alias("docs"), F.max("doc_id").alias("last"))
        .where(F.col("docs") >= min_docs)
    )
    counted = materialize(counted, "line-counts")
    shards = max(1, -(-counted.count() // shard_keys), -(-lines.count() // SHARD_PROBES))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        # Two keys with one first hash: the later ones are left to the spill list.
        frame = frame.sort_values(["h", "f"])
        again = frame["h"].duplicated().to_numpy()
        spill, frame = frame[again], frame[~again]
        hashes = frame["h"].to_numpy().view(np.uint64)
        function = PerfectHash(hashes)
        at = function.index(hashes)
        arrays = []
        for name in ("f", "docs", "last"):
            values = np.zeros(len(frame), np.int64)
            values[at] = frame[name].to_numpy()
            arrays.append(values.tobytes())
        return pd.DataFrame(
            {
                "shard": [int(frame["shard"].iloc[0])],
                "copies": [1 + (int(frame["docs"].sum()) + int(spill["docs"].sum())) // COPY_PROBES],
                "function": [function.packed()],
                "fingerprint": [arrays[0]],
                "docs": [arrays[1]],
                "last": [arrays[2]],
                "spill": [spill[["h", "f", "docs", "last"]].to_numpy(np.int64).tobytes()],
            }
        )

    dealt = counted.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    schema = "shard int, copies int, function binary, fingerprint binary, docs binary, last binary, spill binary"
    return materialize(dealt.groupBy("shard").applyInPandas(build, schema), "line-shards"), shards


class ShardArrays:
    def __init__(self, row):
        self.function = PerfectHash.unpacked(bytes(row["function"]))
        self.fingerprint, self.docs, self.last = (np.frombuffer(row[c], np.int64) for c in ("fingerprint", "docs", "last"))
        self.spill = np.frombuffer(row["spill"], np.int64).reshape(-1, 4)

    def probe(self, h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document count and last document of every key, 0 and 0 where the table lacks it."""
        at = self.function.index(h.view(np.uint64))
        hit = at >= 0
        hit[hit] = self.fingerprint[at[hit]] == f[hit]
        docs, last = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        docs[hit], last[hit] = self.docs[at[hit]], self.last[at[hit]]
        for sh, sf, n, d in self.spill:
            same = (h == sh) & (f == sf)
            docs[same], last[same] = n, d
        return docs, last


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(doc_id, h, f) of the keys a document has to give up."""
    lines = materialize(line_rows(docs, min_chars), "lines")
    shards, n = build_shards(lines, min_docs, shard_keys)
    none = F.lit(None).cast("binary")
    copy = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    no = F.lit(0).cast("long")
    arrays = shards.select(
        "shard", copy, F.lit(0).alias("kind"), no.alias("doc_id"), no.alias("h"), no.alias("f"), *ARRAYS
    )
    several = shards.where("copies > 1").select("shard", "copies")
    probes = (
        lines.withColumn("shard", F.pmod("h", F.lit(n)).cast("int"))
        .join(several, "shard", "left")
        .select(
            "shard",
            F.pmod(F.xxhash64("doc_id"), F.coalesce("copies", F.lit(1))).cast("int").alias("copy"),
            F.lit(1).alias("kind"),
            "doc_id",
            "h",
            "f",
            *[none.alias(c) for c in ARRAYS],
        )
    )

    def probe(batches):
        forget()
        at, arrays = None, None
        for batch in batches:
            # Rows come by shard and copy, the arrays before their probes.
            place = batch["shard"].to_numpy(np.int64) * 2**31 + batch["copy"].to_numpy(np.int64)
            edge = np.flatnonzero(np.diff(place)) + 1
            for part in np.split(np.arange(len(batch)), edge):
                rows = batch.iloc[part]
                if int(place[part[0]]) != at:
                    at, arrays = int(place[part[0]]), None
                if rows["kind"].iloc[0] == 0:
                    arrays = ShardArrays(rows.iloc[0])
                    rows = rows.iloc[1:]
                if arrays is None or rows.empty:
                    continue
                n_docs, last = arrays.probe(rows["h"].to_numpy(np.int64), rows["f"].to_numpy(np.int64))
                give = (n_docs > 0) & (rows["doc_id"].to_numpy(np.int64) != last)
                yield rows.loc[give, ["doc_id", "h", "f"]]

    stream = arrays.unionByName(probes).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    return stream.mapInPandas(probe, "doc_id long, h long, f long")


def _dropped_places(lines: Column, gone: Column) -> Column:
    """Places of the lines whose key's hash is in ``gone``, in no order.

    Lines and hashes are sorted together, so that a run of equal hashes starts
    with a mark if it has to go; the work grows with n log n of the lines.
    """

    def cut(ordered: Column) -> Column:
        size = F.size(ordered)
        at = lambda i: F.get(ordered, i)
        starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (at(i)["h"] != at(i - 1)["h"]))

        def runs(begin: Column) -> Column:
            spans_ = F.transform(begin, lambda i, k: F.struct(i.alias("start"), F.coalesce(F.get(begin, k + 1), size).alias("end")))
            marked = F.filter(spans_, lambda r: at(r["start"])["place"] < 0)
            return F.flatten(F.transform(marked, lambda r: F.transform(F.slice(ordered, r["start"] + 2, r["end"] - r["start"] - 1), lambda z: z["place"])))

        return bound(starts, runs)

    own = F.transform(lines, lambda line, i: F.struct(_hashes(key(line))[0].alias("h"), i.alias("place")))
    marks = F.transform(gone, lambda h: F.struct(h.alias("h"), F.lit(-1).alias("place")))
    return bound(F.array_sort(F.concat(own, marks)), cut)


def without_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(row, n_lines, n_dropped, kept_text): every row of ``docs`` as one struct, beside what its text becomes.

    A missing or empty text is one empty line and is kept (as the empty text).
    A number that repeats counts as one document for a key and all its rows
    keep or lose the same keys. Rows without a number count for no key and
    lose every key of the table. The work of a row grows with n log n of its
    lines, however long it is.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_NUMBER)).alias("id")
    )
    gone = repeated_lines(texts(docs), min_docs, min_chars, shard_keys)
    # A document's own lines bound its list.
    gone = materialize(gone.groupBy("doc_id").agg(F.collect_set("h").alias("gone")).withColumnRenamed("doc_id", "id"), "lines-gone")
    lines = F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n", -1)

    def kept(all_: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), _dropped_places(all_, F.col("gone")))
        return F.when(F.col("gone").isNull(), all_).otherwise(F.transform(places, lambda i: F.get(all_, i)))

    def counted(all_: Column) -> Column:
        return bound(kept(all_), lambda k: F.struct(F.size(all_).alias("n"), F.size(k).alias("left"), F.array_join(k, "\n").alias("text")))

    # One plan at every size: rows meet their hashes by a shuffle also where the hashes are few.
    out = rows.join(gone.hint("merge"), "id", "left").select("row", bound(lines, counted).alias("kept"))
    return out.select(
        "row",
        F.col("kept.n").cast("long").alias("n_lines"),
        (F.col("kept.n") - F.col("kept.left")).cast("long").alias("n_dropped"),
        F.col("kept.text").alias("kept_text"),
    )


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Adds n_lines, n_dropped and kept_text to (doc_id, text) rows by ``without_repeated_lines``.

    All other columns stay as they are, whatever their names; the three new
    ones replace columns of the same name.
    """
    new = ("n_lines", "n_dropped", "kept_text")
    made = without_repeated_lines(docs, min_docs, min_chars, shard_keys)
    return made.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in new], *new)


_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key AS held, max(doc_id) AS final FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.i, k.line, coalesce(k.doc_id <> c.final, FALSE) AS gone FROM k LEFT JOIN c ON k.key = c.held)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


@query(sql=_SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that at least two later-kept documents repeat."""
    cleaned = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
