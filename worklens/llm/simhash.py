"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into m segments laid in a ring. If two fingerprints
differ in at most t bits, some segment starts a chain in which every prefix of
l segments differs in at most l*t/m bits (Qin and Xiao, VLDB 2018). With
t < m the first segment of that chain is equal, so fingerprints meet in
buckets of one equal segment, and the chain condition prunes them segment by
segment before the whole distance is known. With t >= m the buckets find the
pairs that share a whole segment; the chance to share one is then set by the
number and width of the segments.

Equal fingerprints are one node. Inside a bucket only a minimum spanning
forest of the links is emitted: the same components, one row per node instead
of one per pair. A bucket of more than ``BLOCK`` nodes is cut into blocks and
every two blocks are compared in a task of their own; nothing is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm.arrays import Words, encoded, mix, ngrams, spans
from worklens.llm.components import components
from worklens.llm.frames import NO_NUMBER, numbered, texts
from worklens.llm.registry import query, table
from worklens.session import materialize

BLOCK = 4096
#: Groups up to this size are compared together, larger ones each on its own.
SMALL = 64


def majority(hashes: np.ndarray) -> bytes:
    """The bits set in over half of the 64-bit hashes, most significant first; none give zeros."""
    if not len(hashes):
        return bytes(8)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes)).tobytes()


def shingle_fingerprint(text: bytes, words: int = 3, seed: int = 42) -> bytes:
    """64-bit SimHash over all word shingles, repeats included, by XXH64."""
    parts = text.lower().split()
    if not parts:
        return bytes(8)
    rows = map(b" ".join, zip(*(parts[k:] for k in range(words)), strict=False)) if len(parts) >= words else [b" ".join(parts)]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, seed) for s in rows], np.uint64))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) by ``shingle_fingerprint``; a missing text is empty, a missing number NO_NUMBER."""

    def run(batches):
        for batch in batches:
            raw = encoded(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": [shingle_fingerprint(t, words, seed) for t in raw]})

    return texts(docs).mapInPandas(run, "doc_id long, fp binary")


class _Forest:
    def __init__(self):
        self.up: dict = {}

    def join(self, a, b) -> bool:
        up = self.up
        for x in (a, b):
            up.setdefault(x, x)
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        up[b] = a
        return a != b


class Ring:
    """Fingerprints of ``bits`` bits as a ring of ``segments`` segments of whole bytes, linked within ``budget`` bits."""

    def __init__(self, bits: int, segments: int, budget: int):
        self.segments, self.budget, self.width = segments, budget, bits // 8 // segments
        if self.width * segments * 8 != bits or self.width > 8:
            raise ValueError("segments must be whole bytes of equal width")

    def cut(self, fp: np.ndarray) -> np.ndarray:
        """Bytes of fingerprints as one number per segment."""
        parts = fp.reshape(len(fp), self.segments, self.width)
        wide = np.zeros((*parts.shape[:2], 4 if self.width <= 4 else 8), np.uint8)
        wide[:, :, : self.width] = parts
        return wide.view(np.uint32 if self.width <= 4 else np.uint64)[:, :, 0]

    def chain(self, left: np.ndarray, right: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of cut rows pass, and their distance: the chain grows one segment at a time and drops pairs over budget."""
        alive, total = np.arange(len(left)), np.zeros(len(left), np.int64)
        for k in range(self.segments):
            at = (start[alive] + k) % self.segments
            total[alive] += np.bitwise_count(left[alive, at] ^ right[alive, at])
            alive = alive[total[alive] * self.segments <= (k + 1) * self.budget]
        return alive, total[alive]

    def forest(self, node: np.ndarray, fp: np.ndarray, start: int) -> list[tuple[int, int, int]]:
        """Minimum spanning forest of a large bucket, one nearest node at a time."""
        n = len(node)
        best, link = np.full(n, self.budget + 1), np.full(n, -1)
        out, left = [], np.ones(n, bool)
        now = 0
        for _ in range(n):
            left[now] = False
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            ok, distance = self.chain(np.broadcast_to(fp[now], (len(rest), fp.shape[1])), fp[rest], np.full(len(rest), start))
            closer = distance < best[rest[ok]]
            at = rest[ok][closer]
            best[at], link[at] = distance[closer], now
            now = int(rest[best[rest].argmin()])
            if link[now] >= 0:
                out.append((int(node[link[now]]), int(node[now]), int(best[now])))
        return out

    def small(self, node: np.ndarray, fp: np.ndarray, group: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
        """Spanning forests of many small buckets at once."""
        found = []
        for gap in range(1, SMALL):
            same = np.flatnonzero(group[gap:] == group[:-gap]) if gap < len(group) else []
            if not len(same):
                break
            ok, distance = self.chain(fp[same], fp[same + gap], start[same])
            found.append(np.stack([group[same[ok]], distance, same[ok], same[ok] + gap]))
        if not found:
            return []
        rows = np.concatenate(found, axis=1)
        rows = rows[:, np.lexsort((rows[1], rows[0]))]
        forest, out = _Forest(), []
        for g, d, a, b in rows.T.tolist():
            if forest.join((g, int(node[a])), (g, int(node[b]))):
                out.append((int(node[a]), int(node[b]), d))
        return out


def links(nodes: DataFrame, bits: int = 64, segments: int = 4, budget: int = 3) -> DataFrame:
    """(a, b, distance) that connect all nodes (node, fp) the ring links; a bucket gives a spanning forest."""
    ring = Ring(bits, segments, budget)
    places = F.explode(F.sequence(F.lit(0), F.lit(segments - 1)))
    keyed = nodes.select("node", "fp", places.alias("segment")).select(
        "node", "segment", F.substring("fp", F.col("segment") * ring.width + 1, F.lit(ring.width)).alias("value")
    )
    sizes = keyed.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    # Every two blocks of a bucket meet once; a bucket of one block is one group.
    other = F.explode(F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda x: x != F.col("own"))))
    # Most nodes are alone in most of their buckets: fingerprints travel only to those they share.
    met = keyed.join(materialize(sizes, "buckets").withColumn("k", blocks).drop("n"), ["segment", "value"])
    dealt = (
        materialize(met, "bucket-members")
        .join(nodes.select("node", "fp"), "node")
        .withColumn("own", own)
        .select("*", other.alias("other"))
        .select("segment", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "fp")
    )
    key = ["segment", "value", "i", "j"]
    ordered = dealt.repartition(*key).sortWithinPartitions(*key)

    def groups(batches):
        """Frames of whole groups: a group that goes on in the next batch waits for it."""
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = batch[key].iloc[-1]
            going = (batch[key] == last).all(axis=1).to_numpy()
            held = batch[going]
            if not going.all():
                yield batch[~going]
        if held is not None:
            yield held

    def run(batches):
        for frame in groups(batches):
            node = frame["node"].to_numpy(np.int64)
            fp = ring.cut(np.frombuffer(b"".join(frame["fp"]), np.uint8).reshape(len(frame), -1))
            start = frame["segment"].to_numpy(np.int64)
            edge = np.ones(len(frame), bool)
            edge[1:] = (frame[key].iloc[1:].to_numpy() != frame[key].iloc[:-1].to_numpy()).any(axis=1)
            group = np.cumsum(edge) - 1
            count = np.bincount(group)
            few = count[group] <= SMALL
            out = ring.small(node[few], fp[few], group[few], start[few])
            first = np.flatnonzero(edge)
            for g in np.flatnonzero(count > SMALL).tolist():
                part = slice(first[g], first[g] + count[g])
                out += ring.forest(node[part], fp[part], int(start[first[g]]))
            if out:
                yield pd.DataFrame(out, columns=["a", "b", "distance"])

    return ordered.mapInPandas(run, "a long, b long, distance int")


def simhash_components(docs: DataFrame, words: int = 3, segments: int = 4, budget: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    component_id is the least doc_id reachable over links of at most
    ``budget`` differing bits. Equal texts share a fingerprint; texts without
    words have the zero one and link like any other. Rows without a number
    have a fingerprint and no component. A number with several texts links
    them. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, words), "fingerprints")
    known = rows.where(F.col("doc_id") != NO_NUMBER)
    nodes = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = materialize(links(nodes, 64, segments, budget), "links")
    groups = components(found, "a", "b")
    named = nodes.join(groups, "node", "left").select(F.col("fp"), F.coalesce("component", "node").alias("component_id"))
    placed = rows.join(materialize(named, "named"), "fp", "left")
    return numbered(
        placed.select(
            "doc_id",
            F.lower(F.hex("fp")).alias("fingerprint"),
            F.when(F.col("doc_id") != NO_NUMBER, F.col("component_id")).alias("component_id"),
        )
    )


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return simhash_components(table(spark, sf_dir, "documents"))
