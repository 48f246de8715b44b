"""Vector codes: product quantization by member-resident Lloyd rounds.

A vector is cut into parts, one per position, and every position has a
codebook of a few entries. The parts are the rows of a table dealt by
(position, entry, salt), so an owner holds members of one entry and salts
split an entry that takes most rows. A round has three steps:

* every owner assigns its resident members by the codebook of the round;
  members that keep their entry are written back where they are;
* only those whose entry changes are shuffled to their new owners;
* owners sum their members, and the sums of an entry give its next value.

All values are integers and sums are exact, so codes do not depend on how rows
are dealt. What passes the driver is the codebook: positions x entries rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm.registry import query, table
from worklens.session import materialize

POSITIONS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Members of an owner if one entry held all rows of its position.
OWNER_MEMBERS = 1000
#: Components are held within this many units, so that distances of up to 2,048 components fit 64 bits.
MOST = 2**25 - 1
#: Parts compared with a codebook at once.
BATCH = 50_000


def nearest(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the lower index of equals) and squared distance of every part."""
    best = np.zeros(len(parts), np.int64)
    least = np.full(len(parts), np.iinfo(np.int64).max)
    for k, entry in enumerate(codebook):
        gap = parts - entry
        distance = np.einsum("ij,ij->i", gap, gap)
        closer = distance < least
        best[closer], least[closer] = k, distance[closer]
    return best, least


def whole_vectors(vectors: DataFrame, positions: int, scale: int) -> DataFrame:
    """(row, vec_id, label, ints) of the rows that can be coded, written once."""
    x = F.col("embedding")
    fits = x.isNotNull() & (F.size(x) > 0) & (F.size(x) % positions == 0)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    held = lambda v: F.greatest(F.least(F.floor(v.cast("double") * scale), F.lit(MOST)), F.lit(-MOST)).cast("int")
    kept = vectors.where(fits & finite).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").alias("label"),
        F.transform(x, held).alias("ints"),
    )
    return materialize(kept, "vectors")


def first_codebook(vectors: DataFrame, positions: int, entries: int) -> np.ndarray:
    """[position, entry, component] of the least vec_ids; a repeated vec_id counts once, with its least vector."""
    by_id = vectors.where("vec_id IS NOT NULL").orderBy("vec_id", "ints").limit(1).collect()
    if not by_id:
        return np.zeros((positions, 0, 0), np.int64)
    size = len(by_id[0]["ints"])
    alike = vectors.where((F.size("ints") == size) & F.col("vec_id").isNotNull())
    ids = [r["vec_id"] for r in alike.select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    seeds = alike.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("ints").alias("ints")).orderBy("vec_id").collect()
    return np.array([r["ints"] for r in seeds], np.int64).reshape(len(seeds), positions, -1).transpose(1, 0, 2)


def _members(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("position").to_numpy(zero_copy_only=False), batch.column("part").flatten().to_numpy().reshape(-1, width)


def _lists(parts: np.ndarray) -> pa.Array:
    edges = np.arange(0, parts.size + 1, parts.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.ascontiguousarray(parts, dtype=np.int32).reshape(-1)))


MEMBER = "position int, entry int, salt int, row long, part array<int>"


def cut(vectors: DataFrame, size: int, positions: int, salts: int) -> DataFrame:
    """Every part of every vector as a member without an entry yet."""

    def run(batches):
        for batch in batches:
            ints = batch.column("ints").flatten().to_numpy().reshape(-1, size)
            row = batch.column("row").to_numpy()
            n = len(row) * positions
            salt = (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(salts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.arange(positions, dtype=np.int32), len(row))),
                    pa.array(np.full(n, -1, np.int32)),
                    pa.array(np.repeat(salt, positions).astype(np.int32)),
                    pa.array(np.repeat(row, positions)),
                    _lists(ints.reshape(n, size // positions)),
                ],
                names=["position", "entry", "salt", "row", "part"],
            )

    return vectors.select("row", "ints").mapInArrow(run, MEMBER)


def assign(members: DataFrame, codebook: np.ndarray, last: bool = False) -> DataFrame:
    """Members with their entry by the codebook, and ``moved``; the ``last`` time without parts but with ``distance``."""
    width = codebook.shape[2]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                position, part = _members(batch, width)
                part = part.astype(np.int64)
                entry, distance = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                for p in np.unique(position).tolist():
                    at = np.flatnonzero(position == p)
                    entry[at], distance[at] = nearest(part[at], codebook[p])
                now = pa.array(entry.astype(np.int32))
                if last:
                    yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("position"), now, pa.array(distance)], names=["row", "position", "entry", "distance"])
                else:
                    moved = pa.array(entry != batch.column("entry").to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("position"), now, batch.column("salt"), batch.column("row"), _lists(part), moved],
                        names=["position", "entry", "salt", "row", "part", "moved"],
                    )

    return members.mapInArrow(run, "row long, position int, entry int, distance long" if last else f"{MEMBER}, moved boolean")


def resident(assigned: DataFrame) -> DataFrame:
    """Members at their owners: those that moved are shuffled there, the others stay in their files."""
    owner = ("position", "entry", "salt")
    movers = assigned.where("moved").drop("moved").repartition(*owner).sortWithinPartitions(*owner)
    return assigned.where("NOT moved").drop("moved").unionByName(materialize(movers, "vector-movers"))


def update(members: DataFrame, codebook: np.ndarray) -> np.ndarray:
    """The next codebook: floor of sum / count over an entry's members; an entry without members stays."""
    sums = [F.sum(F.element_at("part", k + 1).cast("decimal(38,0)")).alias(f"s{k}") for k in range(codebook.shape[2])]
    new = codebook.copy()
    for r in members.groupBy("position", "entry").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        new[r["position"], r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(codebook.shape[2])]
    return new


def codebook_digest(codebook: np.ndarray) -> str:
    """SHA-256 of all decimal components by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebook.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, positions: int = POSITIONS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every coded row, and the codebook [position, entry, component].

    A vector that is null, empty, holds null or non-finite components, or has
    another length than the vector of the least vec_id (or one that positions
    do not divide) is dropped. Components are floor(scale * x), held within
    +-(2^25 - 1). Rows that repeat are coded once each; rows without vec_id are
    coded but start no entry; without any vec_id, or without rows, nothing is
    returned. code holds two hex digits a position. Only vec_id, embedding and
    label are read, other columns cannot clash.
    """
    if entries > 256:
        raise ValueError("an entry is written with two hex digits")
    kept = whole_vectors(vectors.select("vec_id", "embedding", "label"), positions, scale)
    codebook = first_codebook(kept, positions, entries)
    size = positions * codebook.shape[2]
    kept = kept.where(F.size("ints") == size) if size else kept.limit(0)
    if size:
        salts = max(1, -(-kept.count() // OWNER_MEMBERS))
        members = cut(kept, size, positions, salts)
        for _ in range(rounds):
            members = resident(materialize(assign(members, codebook), "vector-members", ("moved",)))
            now = update(members, codebook)
            if (now == codebook).all():
                break  # what follows would repeat this round
            codebook = now
        final = assign(members, codebook, last=True)
    else:
        final = kept.select("row", F.lit(0).alias("position"), F.lit(0).alias("entry"), F.lit(0).cast("long").alias("distance"))
    digits = F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda p: F.lpad(F.hex(p["entry"]), 2, "0"))
    codes = final.groupBy("row").agg(F.lower(F.array_join(digits, "")).alias("code"), F.sum("distance").alias("error"))
    return kept.join(codes, "row").select("vec_id", "label", "code", "error"), codebook


def _sql() -> str:
    """The rounds written out, one set of views each."""
    part = ",\n".join
    views = [
        """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        "p AS (SELECT vec_id, label, pos, list_slice(ints, pos * (len(ints) // 8) + 1, (pos + 1) * (len(ints) // 8)) AS part FROM v, (SELECT unnest(range(8)) AS pos))",
        "s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 16)",
        "c0 AS (SELECT p.pos, s.entry, p.part FROM p JOIN s USING (vec_id))",
    ]
    near = """a{r} AS (SELECT vec_id, pos, entry, d FROM (
    SELECT p.vec_id, p.pos, c.entry, list_sum(list_transform(list_zip(p.part, c.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
        row_number() OVER (PARTITION BY p.vec_id, p.pos
            ORDER BY list_sum(list_transform(list_zip(p.part, c.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.entry) AS n
    FROM p JOIN c{r} c USING (pos)) WHERE n = 1)"""
    for r in range(ROUNDS):
        views.append(near.format(r=r))
        views.append(
            f"""m{r} AS (SELECT a.pos, a.entry, i, CAST(sum(p.part[i]) AS HUGEINT) AS t, count(*) AS n
    FROM a{r} a JOIN p USING (vec_id, pos), (SELECT unnest(range(1, (SELECT max(len(part)) FROM p) + 1)) AS i) GROUP BY a.pos, a.entry, i)"""
        )
        views.append(
            f"""c{r + 1} AS (SELECT c.pos, c.entry, coalesce(g.part, c.part) AS part FROM c{r} c LEFT JOIN (
    SELECT pos, entry, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY i) AS part FROM m{r} GROUP BY pos, entry) g USING (pos, entry))"""
        )
    views.append(near.format(r=ROUNDS))
    views.append(f"e AS (SELECT vec_id, lower(string_agg(printf('%02x', entry), '' ORDER BY pos)) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)")
    views.append(f"h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos, entry, i)) AS digest FROM (SELECT pos, entry, unnest(part) AS x, generate_subscripts(part, 1) AS i FROM c{ROUNDS}))")
    return (
        f"WITH {part(views)}\nSELECT e.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h.digest AS codebooks_sha256\n"
        "FROM e JOIN v USING (vec_id), h"
    )


@query(sql=_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code and error, its label's error and the digest of the codebooks."""
    coded, codebook = vector_codes(table(spark, sf_dir, "embeddings"))
    coded = materialize(coded, "vector-codes")
    labels = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(codebook)).alias("codebooks_sha256"))
