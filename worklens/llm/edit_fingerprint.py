"""Document fingerprints by a randomised edit embedding.

All texts are read by the same random walk (Chakraborty, Goldenberg and
Koucky, STOC 2016): step j writes the character under the pointer and moves on
by one or not, as a shared random bit of (j, character) says. After an edit
the walks of two texts soon meet again, so edit distance becomes Hamming
distance of what is written.

A fingerprint keeps ``CELLS`` sampled steps. Cell k reads the last step of its
own sequence of record positions before the walk ends: the place of the least
random value among all steps so far. Such a place is uniform over the walk
whatever its length, and walks of nearly equal length choose the same one.
The cell holds four bits of a hash of the character, one hexadecimal digit.

Likeness is the share of equal cells. Near duplicates meet when a band of
sampled cells is equal and are verified on all cells.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm.arrays import encoded, mix, random_table, spans
from worklens.llm.components import components
from worklens.llm.frames import NO_NUMBER, numbered, texts, whole_groups
from worklens.llm.registry import query, table
from worklens.session import materialize

CELLS = 64
#: Steps after which the shared random bits come round again.
PERIOD = 4096
#: Classes that characters are hashed to; the last one marks the end of a text.
CLASSES = 256
END = 255
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


@lru_cache(maxsize=1)
def _steps() -> np.ndarray:
    """Move or stay, by step and character class; nothing moves past the end."""
    moves = np.random.default_rng(71).integers(0, 2, (PERIOD, CLASSES)).astype(np.int64)
    moves[:, END] = 0
    return moves


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Four bits of every character class."""
    return (mix(np.arange(CLASSES)) >> np.uint64(60)).astype(np.uint8)


class _Records:
    """Steps at which each cell's sample moves on, found as far as walks have gone."""

    def __init__(self, cells: int):
        self.least, self.upto, self.at = np.full(cells, np.iinfo(np.uint64).max, np.uint64), 0, {}
        self.keys = random_table(cells, 72)

    def reach(self, steps: int) -> dict[int, np.ndarray]:
        while self.upto < steps:
            span = np.arange(self.upto, self.upto + 4096, dtype=np.uint64)
            for cell in range(len(self.keys)):
                value = mix(span * np.uint64(0x9E3779B97F4A7C15) + self.keys[cell])
                low = np.minimum.accumulate(np.concatenate([self.least[cell : cell + 1], value]))
                for j in (np.flatnonzero(low[1:] < low[:-1]) + self.upto).tolist():
                    self.at.setdefault(j, []).append(cell)
                self.least[cell] = low[-1]
            self.upto += 4096
        return self.at


@lru_cache(maxsize=1)
def _records() -> _Records:
    return _Records(CELLS)


def _classes(codes: np.ndarray) -> np.ndarray:
    return (mix(codes) % np.uint64(END)).astype(np.uint8)


def embed(texts_: list[np.ndarray]) -> list[str]:
    """Fingerprints of texts given as arrays of code points: all walks go on side by side."""
    n = len(texts_)
    sizes = np.array([len(t) for t in texts_], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat = np.full(int(sizes.sum()) + n, END, np.uint8)
    begin = np.zeros(n, np.int64)
    at = 0
    for row, i in enumerate(order.tolist()):
        flat[at : at + sizes[i]] = _classes(texts_[i])
        begin[row] = at
        at += int(sizes[i]) + 1
    moves, symbols, records = _steps(), _symbols(), _records()
    samples = np.zeros((n, CELLS), np.uint8)
    rows, place = np.arange(n), begin
    step = 0
    while len(rows):
        wanted = records.reach(step + 256)
        for j in range(step, step + 256):
            seen = flat[place]
            if j in wanted:
                on = np.flatnonzero(seen != END)
                samples[np.ix_(rows[on], wanted[j])] = symbols[seen[on]][:, None]
            place = place + moves[j % PERIOD][seen]
        step += 256
        going = flat[place] != END
        rows, place = rows[going], place[going]
    out = [""] * n
    for row, digits in zip(order.tolist(), _DIGITS[samples], strict=True):
        out[row] = digits.tobytes().decode()
    return out


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Share of equal cells, 0 to 1."""
    if not left:
        return np.zeros(0)
    a, b = (np.frombuffer("".join(x).encode(), np.uint8).reshape(len(x), -1) for x in (left, right))
    return (a == b).mean(axis=1)


def points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")


def edited(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The last half of the code points replaced by the first as many of another text."""
    half = len(own) // 2
    return np.concatenate([own[: len(own) - half], other[:half]])


def _digest(codes: np.ndarray) -> str:
    return hashlib.sha256(codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()


def _described(numbers, own: list[np.ndarray], following: list[np.ndarray], prints: list[str], next_prints: list[str]) -> pd.DataFrame:
    changed = [edited(a, b) for a, b in zip(own, following, strict=True)]
    changed_prints = embed(changed)
    return pd.DataFrame(
        {
            "doc_id": numbers,
            "n_chars": [len(a) for a in own],
            "edited_sha256": [_digest(c) for c in changed],
            "fingerprint": prints,
            "edited_fingerprint": changed_prints,
            "near_edited": likeness(prints, changed_prints),
            "near_next": likeness(prints, next_prints),
        }
    )


DESCRIBED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

#: Bytes of text whose walks go side by side.
WALK_BYTES = 12_000_000


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text edited with the next document's, in descending doc_id order.

    The document after the last is the first; a lone one follows itself.
    Documents without a number come last; rows that share a number stand in
    order of a hash of their text. A missing text is empty: its fingerprint is
    all zeros. An empty table gives no rows.

    Rows are dealt in ranges. A range's last document needs the first of the
    following range, so ranges also give out their first and last rows, and
    those meet by range number: one pair per range.
    """
    columns = DESCRIBED.split(", ")
    schema = f"part int, edge string, {DESCRIBED}, text string"

    def run(batches):
        part, first, held = TaskContext.get().partitionId(), True, None

        def edge_row(kind, number, text, fingerprint):
            row = {c.split()[0]: [None] for c in columns} | {"doc_id": [number], "fingerprint": [fingerprint]}
            return pd.DataFrame({"part": [part], "edge": [kind], **row, "text": [text]})

        for batch in batches:
            raw_all, all_numbers = encoded(batch["text"].tolist()), batch["doc_id"].to_numpy()
            for some in spans([len(t) for t in raw_all], WALK_BYTES):
                raw, numbers = raw_all[some], all_numbers[some].tolist()
                own = [points(t) for t in raw]
                prints = embed(own)
                if first:
                    yield edge_row("first", numbers[0], raw[0].decode("utf-8", "surrogatepass"), prints[0])
                    first = False
                if held is not None:
                    own.insert(0, held[1])
                    prints.insert(0, held[2])
                    numbers.insert(0, held[0])
                if len(own) > 1:
                    made = _described(numbers[:-1], own[:-1], own[1:], prints[:-1], prints[1:])
                    made.insert(0, "edge", None)
                    made.insert(0, "part", part)
                    made["text"] = None
                    yield made
                held = (numbers[-1], own[-1], prints[-1])
        if held is not None:
            yield edge_row("last", held[0], held[1].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), held[2])

    order = F.struct((-F.col("doc_id")).alias("down"), F.xxhash64("text").alias("h"))
    rows = texts(docs).withColumn("_key", F.when(F.col("doc_id") == NO_NUMBER, F.struct(F.lit(2**63 - 1).alias("down"), F.xxhash64("text").alias("h"))).otherwise(order))
    ordered = rows.repartitionByRange("_key").sortWithinPartitions("_key").drop("_key")
    made = materialize(ordered.mapInPandas(run, schema), "walks")
    spark = docs.sparkSession
    parts = sorted(r["part"] for r in made.where("edge = 'first'").select("part").collect())
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, following int")
    last = made.where("edge = 'last'").select("part", "doc_id", "text", "fingerprint").join(following, "part")
    head = made.where("edge = 'first'").select(F.col("part").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))

    def close(batches):
        for batch in batches:
            own, after = ([points(t) for t in encoded(batch[c].tolist())] for c in ("text", "next_text"))
            yield _described(batch["doc_id"].tolist(), own, after, batch["fingerprint"].tolist(), batch["next_print"].tolist())

    closed = last.join(head, "following").select("doc_id", "text", "fingerprint", "next_text", "next_print").mapInPandas(close, DESCRIBED)
    names = [c.split()[0] for c in columns]
    return numbered(made.where("edge IS NULL").select(*names).unionByName(closed))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches):
        for batch in batches:
            raw = encoded(batch["text"].tolist())
            numbers = batch["doc_id"].to_numpy()
            for some in spans([len(t) for t in raw], WALK_BYTES):
                yield pd.DataFrame({"doc_id": numbers[some], "fingerprint": embed([points(t) for t in raw[some]])})

    return texts(docs).mapInPandas(run, "doc_id long, fingerprint string")


#: Members of a band's bucket compared in one task.
BLOCK = 4096


def linked(node: np.ndarray, signs: np.ndarray, least: float) -> np.ndarray:
    """Spanning forest (two rows of nodes) of all pairs whose share of equal signs is ``least`` or more."""
    group, out = np.arange(len(node)), []
    for k in range(len(node) - 1):
        rest = np.flatnonzero(group[k + 1 :] != group[k]) + k + 1
        near = rest[(signs[rest] == signs[k]).mean(axis=1) >= least]
        others, first = np.unique(group[near], return_index=True)
        if len(others):
            out.append(np.stack([np.full(len(first), node[k]), node[near[first]]]))
            group[np.isin(group, others)] = group[k]
    return np.concatenate([np.zeros((2, 0), np.int64), *out], axis=1)


def near_duplicates(prints: DataFrame, least: float = 0.8, bands: int = 16, cells: int = 6) -> DataFrame:
    """(doc_id, class_id) by bands of sampled cells and verification on all cells.

    A band is ``cells`` cells drawn at random; two fingerprints that agree in
    all cells of some band are compared in full and linked at likeness
    ``least`` or more. Equal fingerprints are one representative. All members
    of a band's bucket are compared; a bucket of more than ``BLOCK`` is cut
    into blocks and every two blocks meet in a task of their own. Of the links
    found there a spanning forest is handed on.
    """
    known = prints.where(F.col("doc_id") != NO_NUMBER)
    nodes = materialize(known.groupBy("fingerprint").agg(F.min("doc_id").alias("node")), "print-nodes")
    rng = np.random.default_rng(73)
    picks = [sorted(rng.choice(CELLS, cells, replace=False).tolist()) for _ in range(bands)]
    keys = F.array(*[F.concat(F.lit(f"{b}:"), *[F.substring("fingerprint", c + 1, 1) for c in pick]) for b, pick in enumerate(picks)])
    keyed = nodes.select("node", "fingerprint", F.explode(keys).alias("band"))
    sizes = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = materialize(sizes.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("k")), "bands")
    own = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    other = F.explode(F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda x: x != F.col("own"))))
    dealt = keyed.join(blocks, "band").withColumn("own", own).select("*", other.alias("other"))
    dealt = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "fingerprint")
    key = ["band", "i", "j"]

    def compare(batches):
        for frame in whole_groups(batches, key):
            node = frame["node"].to_numpy(np.int64)
            signs = np.frombuffer("".join(frame["fingerprint"]).encode(), np.uint8).reshape(len(frame), -1)
            edge = np.ones(len(frame), bool)
            edge[1:] = (frame[key].iloc[1:].to_numpy() != frame[key].iloc[:-1].to_numpy()).any(axis=1)
            first = np.flatnonzero(edge)
            out = [linked(node[a:b], signs[a:b], least) for a, b in zip(first, np.append(first[1:], len(frame)), strict=True)]
            a, b = np.concatenate([np.zeros((2, 0), np.int64), *out], axis=1)
            yield pd.DataFrame({"a": a, "b": b})

    near = dealt.repartition(*key).sortWithinPartitions(*key).mapInPandas(compare, "a long, b long")
    groups = components(materialize(near.distinct(), "print-links"), "a", "b")
    named = nodes.join(groups, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("class_id"))
    return numbered(prints.join(materialize(named, "print-classes"), "fingerprint", "left").select("doc_id", "class_id"))


@query
def op1_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint against its edited text and the next document."""
    return compare_with_next(table(spark, sf_dir, "documents"))
