"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text; where it is a multiple of
``EVERY`` at the end of a word, a chunk ends. The cut depends on the last
``WINDOW_BYTES`` bytes alone, so an insertion moves cuts only near itself and
a passage is cut alike wherever it stands. Chunks are a few words each, and
many a chunk is met elsewhere by chance; so each is taken with the chunks after
it, or before it, as far as ``CONTEXT_WORDS`` words need. Such a stretch whose
digest another document of a smaller number has, or an earlier place of the
same document, is repeated. Overlapping repeated stretches of at least
``LEAST_WORDS`` words together are a repeated passage.

Short chunks find passages from about twice ``LEAST_WORDS`` words on; a
passage loses at its two ends what the cuts leave over.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from worklens.llm.arrays import Words, encoded, mix, random_table, spans
from worklens.llm.frames import NO_NUMBER, texts
from worklens.llm.registry import query, table
from worklens.session import materialize

WINDOW_BYTES = 16
#: Words between two cuts on average.
EVERY = 3
LEAST_WORDS = 20
#: Words in a row that a chunk and its neighbours must share with one earlier place.
CONTEXT_WORDS = 8


def gear(buffer: np.ndarray) -> np.ndarray:
    """Gear hash of the ``WINDOW_BYTES`` bytes up to each place, by doubling the window."""
    table_ = (random_table(256, 41) >> np.uint64(20)).astype(np.uint32)
    table_[ord("\n")] = 0  # what fills the gap between two texts
    total, width = table_[buffer], 1
    while width < WINDOW_BYTES:
        wider = total.copy()
        wider[width:] += total[:-width] << np.uint32(width)
        total, width = wider, 2 * width
    return total


class Chunks:
    """Chunks of several texts: owner, place in its text, first byte, bytes, words and digest."""

    def __init__(self, raw: list[bytes], every: int = EVERY):
        words = Words([t + b"\n" * (WINDOW_BYTES - 1) for t in raw])
        if not len(words.start):
            self.text = self.place = self.start = self.size = self.words = np.zeros(0, np.int64)
            self.digest, self.again = np.zeros(0, np.int64), np.zeros(0, bool)
            return
        ends = (mix(gear(words.buffer)[words.end - 1]) % np.uint64(every)) == 0
        ends |= np.append(words.text[1:] != words.text[:-1], True)
        last = np.flatnonzero(ends)
        first = np.concatenate([[0], last[:-1] + 1])
        self.text = words.text[first]
        self.words = last - first + 1
        begin = words.start[first]
        self.start, self.size = begin - words.text_start[self.text], words.end[last] - begin
        self.digest = words.hash_of(begin, words.end[last]).view(np.int64)
        edge = np.searchsorted(self.text, np.arange(len(raw)))
        self.place = np.arange(len(first)) - edge[self.text]
        # Not the first of its digest in its text.
        order = np.lexsort((self.place, self.digest, self.text))
        self.again = np.zeros(len(first), bool)
        self.again[order[1:]] = (self.digest[order[1:]] == self.digest[order[:-1]]) & (self.text[order[1:]] == self.text[order[:-1]])


class Stretches:
    """Runs of chunks of ``context`` words or a little more: one from each chunk on, and one up to each chunk where none of those ends."""

    def __init__(self, c: Chunks, context: int):
        n, total = len(c.text), np.concatenate([[0], np.cumsum(c.words)])
        last = np.searchsorted(total, total[:-1] + context) - 1
        first = np.flatnonzero(last < n)
        first = first[c.text[last[first]] == c.text[first]]
        last = last[first]
        rest = np.setdiff1d(np.arange(n), last)
        begin = np.searchsorted(total, total[rest + 1] - context, "right") - 1
        whole = (begin >= 0) & (c.text[begin] == c.text[rest])
        first, last = np.concatenate([first, begin[whole]]), np.concatenate([last, rest[whole]])
        self.text = c.text[first]
        self.place = total[first] - total[np.searchsorted(c.text, self.text)]
        self.words = total[last + 1] - total[first]
        self.start, self.size = c.start[first], c.start[last] + c.size[last] - c.start[first]
        digest = np.zeros(len(first), np.uint64)
        for k in range(int((last - first).max(initial=-1)) + 1):
            more = first + k <= last
            digest[more] = mix(digest[more] * np.uint64(0x9E3779B97F4A7C15) + c.digest[first[more] + k].view(np.uint64))
        self.digest = digest.view(np.int64)
        # Not the first of its digest in its text.
        order = np.lexsort((self.place, self.digest, self.text))
        self.again = np.zeros(len(first), bool)
        self.again[order[1:]] = (self.digest[order[1:]] == self.digest[order[:-1]]) & (self.text[order[1:]] == self.text[order[:-1]])


def stretch_rows(docs: DataFrame, every: int = EVERY, context: int = CONTEXT_WORDS, wide: bool = True) -> DataFrame:
    """One row per stretch of chunks, or with ``wide`` off (digest, doc_id), once per document."""

    def run(batches):
        for batch in batches:
            raw, ids = encoded(batch["text"].tolist()), batch["doc_id"].to_numpy()
            for some in spans([len(t) for t in raw]):
                c = Stretches(Chunks(raw[some], every), context)
                frame = pd.DataFrame({"digest": c.digest, "doc_id": ids[some][c.text]})
                if wide:
                    yield frame.assign(place=c.place, start=c.start, size=c.size, words=c.words, again=c.again)
                else:
                    yield frame[~c.again]

    more = ", place int, start int, size int, words int, again boolean" if wide else ""
    return texts(docs).where(F.col("doc_id") != NO_NUMBER).mapInPandas(run, "digest long, doc_id long" + more)


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, every: int = EVERY) -> DataFrame:
    """(doc_id, start, size, words, kept_in): passages to drop, in bytes of the UTF-8 text.

    ``kept_in`` is the least document that keeps a stretch of the passage. The
    first place of a stretch, by doc_id and then by place, is never dropped.
    Missing and empty texts have no chunks; rows without a number take no
    part; rows that share a number and a text are one document.
    """
    context = min(CONTEXT_WORDS, least_words)
    held = stretch_rows(docs, every, context, wide=False).groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
    shared = materialize(held.where("last <> keeper").drop("last"), "shared-stretches")
    rows = stretch_rows(docs, every, context)
    elsewhere = rows.where("NOT again").join(shared, "digest").where("doc_id <> keeper").drop("digest")
    here = rows.where("again").withColumn("keeper", F.col("doc_id")).select(elsewhere.columns)
    dropped = elsewhere.unionByName(here)

    order = W.partitionBy("doc_id").orderBy("place", "words")
    # Words up to which the stretches before reach: one that only touches them was not met beside them.
    reach = F.max(F.col("place") + F.col("words")).over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = dropped.withColumn("fresh", F.coalesce(F.col("place") >= reach, F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(order))
    passages = runs.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"),
        F.max(F.col("start") + F.col("size")).alias("end"),
        (F.max(F.col("place") + F.col("words")) - F.min("place")).cast("long").alias("words"),
        F.min("keeper").alias("kept_in"),
    )
    return passages.where(F.col("words") >= least_words).select(
        "doc_id", F.col("start").cast("long").alias("start"), (F.col("end") - F.col("start")).cast("long").alias("size"), "words", "kept_in"
    )


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """The documents with their passages cut out of ``text``; all columns stay, rows without passages unchanged."""
    cuts = passages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("_cuts"))

    def cut(texts_: pd.Series, cuts_: pd.Series) -> pd.Series:
        out = []
        for text, spans_ in zip(texts_, cuts_, strict=True):
            if text is None or spans_ is None or not len(spans_):
                out.append(text)
                continue
            raw, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
            for span in spans_:
                kept.append(raw[at : span["start"]])
                at = span["start"] + span["size"]
            out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    clean = F.pandas_udf(cut, "string")
    return docs.join(cuts, "doc_id", "left").withColumn("text", clean("text", "_cuts")).select(docs.columns)


@query
def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that an earlier document or an earlier place has too."""
    return repeated_passages(table(spark, sf_dir, "documents"))
