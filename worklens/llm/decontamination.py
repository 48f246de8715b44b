"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are taken in blocks of bounded size, each block against all
documents. First pass over the documents: how often does every n-gram of the
block occur in the corpus? From every ``window`` neighbouring n-grams of an
item the rarest that the corpus has becomes a seed, so a passage that shares
``n + window - 1`` words in a row with an item always shares a seed with it;
rare n-grams are seeds besides, wherever edits stand. Second pass: seeds met
in a document point to a stretch of it, the stretch is aligned with the
item word by word, and the alignment's score says how much of the item is
there, edits included.

Only the block of items and its seeds travel to the tasks; documents are read
where they lie and nothing is shuffled but counts and findings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm.arrays import Words, ngrams, spans
from worklens.llm.frames import NO_NUMBER, numbered, texts
from worklens.llm.registry import query, table
from worklens.llm.tokenization import forget
from worklens.session import materialize

N = 3
WINDOW = 4
#: Words of test items per block, which bounds what is sent to tasks.
BLOCK_WORDS = 1_000_000
#: A seed seen at most once in so many corpus words is rare enough to count alone; others must meet in twos.
RARE_EVERY = 100_000
#: Seen at most so often, every n-gram is a seed, however small the corpus.
FEW = 16
#: Share of the best possible score from which a document holds an item.
LEAST = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1

# Letters and digits make words; A-Z is lower-cased by str.lower beforehand, with all other letters.
_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def plain(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN)


class Block:
    """Test items of one block with their n-grams and seeds."""

    def __init__(self, items: list[tuple[int, str]], n: int, window: int):
        words = Words([plain(t) for _, t in items])
        self.n, self.window = n, window
        self.item = np.array([i for i, _ in items], np.int64)
        self.first, self.hashes = words.first, words.hashes()
        self.sizes = words.count
        # An item shorter than n words is one n-gram of what it has.
        grams = [ngrams(self.hashes[a:b], min(n, b - a)) if b > a else np.zeros(0, np.uint64) for a, b in zip(self.first[:-1], self.first[1:], strict=True)]
        self.gram = np.concatenate([np.zeros(0, np.uint64), *grams])
        self.of = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        self.at = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]]).astype(np.int64)
        self.lengths = sorted({min(n, int(s)) for s in self.sizes if s})
        self.distinct = np.unique(self.gram)

    def seed(self, counts: dict[int, int], corpus_words: int) -> None:
        """Keep the rarest n-gram of every window that the corpus has, ties going to the smaller hash, and all rare or few ones."""
        seen = np.array([counts.get(int(g), 0) for g in self.distinct.view(np.int64)], np.int64)
        count = seen[np.searchsorted(self.distinct, self.gram)]
        # What an edit made has no place in the corpus: it must not stand in for an n-gram beside it.
        rank = np.lexsort((self.gram, count, count == 0)).argsort()
        keep = np.zeros(len(self.gram), bool)
        edges = np.flatnonzero(np.diff(np.concatenate([[-1], self.of, [-1]])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for k in range(a, max(a + 1, b - self.window + 1)):
                keep[k + int(rank[k : min(b, k + self.window)].argmin())] = True
        keep &= count > 0
        rare = count * RARE_EVERY <= max(corpus_words, RARE_EVERY)
        self.single = np.bincount(self.of[keep], minlength=len(self.item)) == 1
        keep |= (rare | (count <= FEW)) & (count > 0)
        order = np.flatnonzero(keep)[np.argsort(self.gram[keep], kind="stable")]
        self.seed_gram, self.seed_of, self.seed_at = self.gram[order], self.of[order], self.at[order]
        self.seed_rare = rare[order]
        del self.gram, self.of, self.at


def _grams(words: Words, lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, word index) of all n-grams inside one text, for each length."""
    hashes = words.hashes()
    for n in lengths:
        grams = ngrams(hashes, n)
        inside = words.text[: len(grams)] == words.text[n - 1 :] if len(grams) else np.zeros(0, bool)
        yield grams[inside], np.flatnonzero(inside)


def align(items: list[np.ndarray], stretches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment (Smith-Waterman) of every pair: score, and first and last+1 word of the stretch.

    All pairs advance together, one item word a step. A gap along the stretch
    is a running maximum, because each further word costs the same. The start
    travels with the score.
    """
    n, rows, columns = len(items), max(map(len, items)), max(map(len, stretches))
    left, right = np.zeros((rows, n), np.uint64), np.ones((n, columns), np.uint64)
    for k, (a, b) in enumerate(zip(items, stretches, strict=True)):
        left[: len(a), k], right[k, : len(b)] = a | np.uint64(2), b | np.uint64(2)
    # Score and start packed in one number, so that a maximum carries both: earlier starts lose ties.
    base = np.int64(1 << 24)
    place = np.arange(columns, dtype=np.int64)
    ramp = -GAP * base * place
    before = np.zeros((n, columns), np.int64)
    best, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(rows):
        same = right == left[i][:, None]
        step = np.where(same, MATCH, MISMATCH) * base
        shifted = np.concatenate([np.zeros((n, 1), np.int64), before[:, :-1]], axis=1)
        fresh = shifted < base  # nothing before: an alignment would start here
        now = np.where(fresh, place[None, :], shifted) + step
        now = np.maximum(now, before + GAP * base)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        now[now < base] = 0
        before = now
        at = now.argmax(axis=1)
        top = now[np.arange(n), at]
        more = top // base > best // base
        best[more], end[more] = top[more], at[more] + 1
    return best // base, best % base, end


def _findings(block: Block, words: Words, least: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, last word + 1) of the texts laid out in ``words``."""
    parts = []
    for grams, at in _grams(words, block.lengths):
        low, high = np.searchsorted(block.seed_gram, grams), np.searchsorted(block.seed_gram, grams, "right")
        hit = np.flatnonzero(high > low)
        times = (high - low)[hit]
        seed = np.repeat(low[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        where = np.repeat(at[hit], times)
        parts.append((words.text[where], block.seed_of[seed], where - words.first[words.text[where]], seed))
    text, item, where, seed = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(text):
        return []
    diagonal = where - block.seed_at[seed]
    order = np.lexsort((seed, diagonal, item, text))
    text, item, diagonal, seed = text[order], item[order], diagonal[order], seed[order]
    # Hits of one item whose diagonals lie close belong to one stretch.
    slack = 4 + block.sizes[item] // 4
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])
    group = np.cumsum(new) - 1
    rare = np.bincount(group, block.seed_rare[seed]) > 0
    several = np.bincount(group[1:], (seed[1:] != seed[:-1]) & (group[1:] == group[:-1]), minlength=group[-1] + 1) > 0
    # An item with a single seed cannot give two.
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(text)) - 1
    take = np.flatnonzero(rare | several | block.single[item[start]])
    jobs = []
    for g in take.tolist():
        t, m, s = int(text[start[g]]), int(item[start[g]]), int(slack[start[g]])
        a = max(0, int(diagonal[start[g]]) - s)
        b = min(int(words.count[t]), int(diagonal[last[g]]) + int(block.sizes[m]) + s)
        # Repeats of an item chain into one long stretch: it is aligned in overlapping parts of bounded length.
        span = 3 * int(block.sizes[m]) + 2 * s
        for low in range(a, b, span - int(block.sizes[m]) - s):
            jobs.append((t, m, low, min(b, low + span)))
            if low + span >= b:
                break
    found = []
    hashes = words.hashes()
    jobs.sort(key=lambda j: (block.sizes[j[1]], j[3] - j[2]))
    cells = [int(block.sizes[m]) + (b - a) for _, m, a, b in jobs]
    for some in spans(cells, 100_000):
        batch = jobs[some]
        score, low, high = align(
            [block.hashes[block.first[m] : block.first[m + 1]] for _, m, _, _ in batch],
            [hashes[words.first[t] + a : words.first[t] + b] for t, _, a, b in batch],
        )
        for (t, m, a, _), s, x, y in zip(batch, score.tolist(), low.tolist(), high.tolist(), strict=True):
            share = s / (MATCH * int(block.sizes[m]))
            if share >= least:
                found.append((t, int(block.item[m]), share, a + x, a + y))
    return found


def _blocks(benchmark: DataFrame, n: int, window: int) -> Iterator[Block]:
    """Items in order of their number, read a row at a time; a block is closed when it is full."""
    items, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        items.append((row[0], row[1]))
        size += row[1].count(" ") + 1
        if size >= BLOCK_WORDS:
            yield Block(items, n, window)
            items, size = [], 0
    if items:
        yield Block(items, n, window)


FOUND = "doc_id long, item_id long, score double, first_word int, last_word int"


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, window: int = WINDOW, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): documents that hold an item, and where.

    Score is the alignment's share of a perfect one. A document can hold an
    item once or more; the best place is given. Missing and empty texts and
    items without words hold nothing; items without a number are passed over;
    rows without a number are reported under NULL. Rows that repeat a number
    count as one document.
    """
    spark, rows = docs.sparkSession, texts(docs)
    out = spark.createDataFrame([], FOUND)
    for block in _blocks(benchmark, n, window):
        sent = spark.sparkContext.broadcast(block)

        def count(batches, sent=sent):
            forget()
            block, total = sent.value, 0
            seen = np.zeros(len(block.distinct), np.int64)
            for batch in batches:
                raw = [plain(t) for t in batch["text"]]
                for some in spans([len(t) for t in raw]):
                    words = Words(raw[some])
                    total += len(words.start)
                    for grams, _ in _grams(words, block.lengths):
                        at = np.minimum(np.searchsorted(block.distinct, grams), len(block.distinct) - 1)
                        seen += np.bincount(at[block.distinct[at] == grams], minlength=len(seen)) if len(seen) else 0
            some = np.flatnonzero(seen)
            yield pd.DataFrame({"kind": "words", "gram": [0], "n": [total]})
            yield pd.DataFrame({"kind": "gram", "gram": block.distinct[some].view(np.int64), "n": seen[some]})

        if not len(block.distinct):
            continue
        counted = rows.mapInPandas(count, "kind string, gram long, n long").groupBy("kind", "gram").agg(F.sum("n").alias("n")).collect()
        block.seed({r["gram"]: r["n"] for r in counted if r["kind"] == "gram"}, sum(r["n"] for r in counted if r["kind"] == "words"))
        seeded = spark.sparkContext.broadcast(block)

        def find(batches, sent=seeded):
            forget()
            block = sent.value
            for batch in batches:
                raw, ids = [plain(t) for t in batch["text"]], batch["doc_id"].to_numpy()
                for some in spans([len(t) for t in raw]):
                    found = _findings(block, Words(raw[some]), least) if len(block.seed_gram) else []
                    if found:
                        frame = pd.DataFrame(found, columns=["text", "item_id", "score", "first_word", "last_word"])
                        frame.insert(0, "doc_id", ids[some][frame.pop("text")])
                        yield frame

        out = out.unionByName(materialize(rows.mapInPandas(find, FOUND), "contamination"))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", -F.col("first_word"), -F.col("last_word"))).alias("b"))
    return numbered(best.select("doc_id", "item_id", F.round("b.score", 6).alias("score"), (-F.col("b.col2")).alias("first_word"), (-F.col("b.col3")).alias("last_word")))


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied, edited or paraphrased."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
