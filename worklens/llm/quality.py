"""Quality selection by importance resampling over hashed n-grams.

Generative models of hashed features (words, word pairs, word shapes) are
counted for the target (good and not toxic labelled text), for every kind of
text to avoid (poor, toxic) and for the raw corpus, all documents of it. The
log ratio target : raw is a document's importance weight (Xie et al., DSIR,
NeurIPS 2023); the k largest weights plus Gumbel noise are a sample without
replacement from the target-like distribution.

A document is rejected when the ratio target : avoided falls below a threshold
for some kind. That ratio counts a feature once per document and only if it
tells of the avoided kind: in at least ``STRENGTH`` times the share of its
documents, and beyond chance by the likelihood ratio. A longer clean text has
more of them by chance. So the sum is taken against what target text of that
length has on average, in units of its spread (of at least 1): clean texts of
any length lie around 0. A text of more than ``STRETCH`` features is summed by
stretches, because in the whole of it every feature would occur. Half of the labelled rows are counted, copies of a text once; the
other half sets the thresholds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm.arrays import Words, encoded, ngrams, spans, sums
from worklens.llm.frames import NO_NUMBER, numbered, share, texts
from worklens.llm.registry import query, table
from worklens.llm.tokenization import forget
from worklens.session import materialize

#: Buckets for words and for pairs; shapes have their own, fewer ones.
WORD_BUCKETS, PAIR_BUCKETS, SHAPE_BUCKETS = 1 << 17, 1 << 14, 1 << 10
FEATURES = WORD_BUCKETS + PAIR_BUCKETS + SHAPE_BUCKETS
#: Times in a row that make a word's repetition a feature.
RUNS = (4, 6)
#: Labelled rows used, chosen by a hash of their number; a broadcast of (number, kind) is bounded by it.
LABELLED = 50_000
#: Likelihood-ratio statistic (G squared) from which a feature's excess in an avoided kind is beyond chance.
TELLING = 16.0
#: Times a feature must be more frequent in the avoided kind's documents than in the target's.
STRENGTH = 5.0
KINDS = ("target", "poor", "toxic")

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_SHAPE = bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else 32 if c in (32, *range(9, 14)) else c
    for c in range(256)
)


def ngram_all(flags: np.ndarray, n: int) -> np.ndarray:
    """Whether the n flags from each place on are all set."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[n:] - total[:-n] == n if len(flags) >= n else np.zeros(0, bool)


def features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature of every occurrence, and where each text's begin (one more entry than texts)."""
    words = Words([t.translate(_PLAIN) for t in raw])
    hashes = words.hashes()
    pairs = ngrams(hashes, 2)
    inside = words.text[:-1] == words.text[1:] if len(hashes) > 1 else np.zeros(0, bool)
    marks = []
    for t in raw:
        codes = np.frombuffer(t.translate(_SHAPE), np.uint8)
        marks.append(codes[np.concatenate([[True], codes[1:] != codes[:-1]])].tobytes() if len(codes) else b"")
    shapes = Words(marks)
    # A word some times in a row is a shape too, the first ones.
    same = (hashes[:-1] == hashes[1:]) & inside if len(hashes) > 1 else inside
    runs = [np.flatnonzero(ngram_all(same, k - 1)) for k in RUNS]
    paired = words.text[:-1][inside] if len(hashes) > 1 else np.zeros(0, np.int64)
    of = np.concatenate([words.text, paired, shapes.text, *[words.text[r] for r in runs]])
    feature = np.concatenate(
        [
            hashes % np.uint64(WORD_BUCKETS),
            pairs[inside] % np.uint64(PAIR_BUCKETS) + np.uint64(WORD_BUCKETS),
            shapes.hashes() % np.uint64(SHAPE_BUCKETS - len(RUNS)) + np.uint64(WORD_BUCKETS + PAIR_BUCKETS + len(RUNS)),
            *[np.full(len(r), WORD_BUCKETS + PAIR_BUCKETS + i, np.uint64) for i, r in enumerate(runs)],
        ]
    ).astype(np.int64)
    order = np.argsort(of, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(raw)))])
    return feature[order], first


def labelled(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, kind, fold) of at most ``most`` labelled documents; a document with several labels has its worst."""
    known = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    kind = F.when(F.col("t") == 1, "toxic").when(F.col("q") == 0, "poor").when(F.col("q") == 1, "target")
    some = one.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most)
    return some.select("doc_id", kind.alias("kind"), (share(F.col("doc_id"), 2)).alias("fold")).where("kind IS NOT NULL")


def _counts(rows: DataFrame) -> np.ndarray:
    """By feature: documents of every kind that have it, its occurrences in target and raw corpus, and in a last column the documents of the kinds."""
    names = [*KINDS, "target occurrences", "raw occurrences"]

    def count(batches):
        forget()
        total = np.zeros((len(names), FEATURES + 1), np.int64)
        for batch in batches:
            raw, kinds, fold = encoded(batch["text"].tolist()), batch["kind"].tolist(), batch["fold"].tolist()
            for some in spans([len(t) for t in raw]):
                feature, first = features(raw[some])
                total[-1, :-1] += np.bincount(feature, minlength=FEATURES)
                for i, (kind, part) in enumerate(zip(kinds[some], fold[some], strict=True)):
                    if kind and part == 0:
                        own, times = np.unique(feature[first[i] : first[i + 1]], return_counts=True)
                        total[KINDS.index(kind), own] += 1
                        total[KINDS.index(kind), -1] += 1
                        if kind == "target":
                            total[-2, own] += times
        kind, feature = np.nonzero(total)
        yield pd.DataFrame({"kind": kind, "feature": feature, "n": total[kind, feature]})

    out = np.zeros((len(names), FEATURES + 1))
    # At most one row per kind and feature comes back, however large the corpus.
    for r in rows.mapInPandas(count, "kind int, feature int, n long").groupBy("kind", "feature").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["kind"], r["feature"]] = r["n"]
    return out


def ratios(counts: np.ndarray) -> np.ndarray:
    """Per feature: log target : raw, then for every avoided kind log target : kind where that tells of it, else 0."""
    parts = [slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, WORD_BUCKETS + PAIR_BUCKETS), slice(WORD_BUCKETS + PAIR_BUCKETS, FEATURES)]
    out = np.zeros((len(KINDS), FEATURES))
    for part in parts:  # each family of features is a distribution of its own
        n = counts[-2:, part] + 0.5
        p = np.log(n / n.sum(axis=1, keepdims=True))
        out[0, part] = p[0] - p[1]
    have, all_ = counts[: len(KINDS), :-1], counts[: len(KINDS), -1]
    for k in range(1, len(KINDS)):
        ratio = np.log((have[0] + 0.5) / (all_[0] + 1)) - np.log((have[k] + 0.5) / (all_[k] + 1))
        share_ = (have[0] + have[k]) / max(1, all_[0] + all_[k])
        with np.errstate(divide="ignore", invalid="ignore"):
            g = 2 * sum(np.where(have[i] > 0, have[i] * np.log(have[i] / (share_ * all_[i])), 0.0) for i in (0, k))
        out[k] = np.where((ratio <= -np.log(STRENGTH)) & (g >= TELLING), ratio, 0.0)
    return out


#: Occurrences of features in a stretch, and the lengths at which ``expected`` is worked out.
STRETCH = 2_000
LENGTHS = np.concatenate([[0.0], np.geomspace(1, STRETCH, 200)])


def expected(counts: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """By avoided kind and length of ``LENGTHS``: mean and variance of the sum of ratios in target text."""
    occurs = counts[len(KINDS), :-1]
    out = np.zeros((len(KINDS) - 1, 2, len(LENGTHS)))
    for k in range(1, len(KINDS)):
        on = np.flatnonzero(table_[k])
        rate = (occurs[on] + 0.5) / max(1.0, occurs.sum())
        for at, length in enumerate(LENGTHS):
            absent = np.exp(-rate * length)
            out[k - 1, 0, at] = table_[k][on] @ (1 - absent)
            out[k - 1, 1, at] = table_[k][on] ** 2 @ (absent * (1 - absent))
    return out


def against_usual(feature: np.ndarray, first: np.ndarray, ratio: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """By text: its sum of ratios less that of target text of its length, over the spread of the latter."""
    size = np.diff(first)
    stretches = np.maximum(1, -(-size // STRETCH))
    owner = np.repeat(np.arange(len(size)), size)
    # Words, pairs and shapes of a text follow each other, each in the order of the text.
    family = owner * 3 + (feature >= WORD_BUCKETS) + (feature >= WORD_BUCKETS + PAIR_BUCKETS)
    count = np.bincount(family, minlength=3 * len(size))
    place = np.arange(len(feature)) - (np.cumsum(count) - count)[family]
    stretch = (np.cumsum(stretches) - stretches)[owner] + place * stretches[owner] // count[family]
    on = ratio[feature] < 0
    own = np.unique(stretch[on] * np.int64(FEATURES) + feature[on])
    text = np.repeat(np.arange(len(size)), stretches)[own // FEATURES]
    total = np.bincount(text, ratio[own % FEATURES], minlength=len(size))
    mean, variance = (stretches * np.interp(size / stretches, LENGTHS, u) for u in usual)
    return (total - mean) / np.sqrt(1 + variance)


def _scored(rows: DataFrame, table_: np.ndarray, usual: np.ndarray) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(table_)

    def score(batches):
        forget()
        ratio = sent.value
        for batch in batches:
            raw = encoded(batch["text"].tolist())
            for some in spans([len(t) for t in raw]):
                feature, first = features(raw[some])
                part = batch.iloc[some]
                tells = {k: against_usual(feature, first, ratio[i + 1], usual[i]) for i, k in enumerate(KINDS[1:])}
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"],
                        "kind": part["kind"],
                        "fold": part["fold"],
                        "log_weight": sums(ratio[0][feature], first),
                        **tells,
                    }
                )

    return rows.mapInPandas(score, "doc_id long, kind string, fold int, log_weight double, poor double, toxic double")


def threshold(clean: np.ndarray, avoid: np.ndarray) -> float:
    """Cut with the fewest misses, a rejected clean document counting five times; never above 0."""
    if not len(avoid) or not len(clean):
        return -np.inf
    values = np.concatenate([clean, avoid])
    order = np.argsort(values, kind="stable")
    bad = np.concatenate([np.zeros(len(clean)), np.ones(len(avoid))])[order]
    loss = 5 * np.concatenate([[0], np.cumsum(1 - bad)]) / len(clean) + (len(avoid) - np.concatenate([[0], np.cumsum(bad)])) / len(avoid)
    at = int(loss.argmin())
    low = values[order[at - 1]] if at else -np.inf
    high = values[order[at]] if at < len(values) else low
    return float(min(0.0, (low + high) / 2 if np.isfinite(low) else low))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, log_weight, poor, toxic, keep) of every row.

    ``poor`` and ``toxic`` are log ratios target : that kind over telling
    features, against those of target text of the same length; ``keep`` is false where one is below its threshold. A missing or
    empty text has no features: all ratios 0, kept. Without labelled rows of a
    kind nothing is rejected for it. Labels of unknown documents do not count;
    a label table's own texts or further columns are not read.
    """
    chosen = materialize(labelled(labels), "labelled")
    # At most LABELLED rows of a number, a word and a digit.
    rows = texts(docs).join(F.broadcast(chosen), "doc_id", "left").withColumn("fold", F.coalesce("fold", F.lit(-1)).cast("int"))
    # A copied text would make its ordinary words telling: only the first labelled row of a text is counted or held.
    first = rows.where("kind IS NOT NULL").groupBy(F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id"))
    chosen = materialize(chosen.join(first.select("doc_id"), "doc_id", "left_semi"), "labelled-once")
    rows = texts(docs).join(F.broadcast(chosen), "doc_id", "left").withColumn("fold", F.coalesce("fold", F.lit(-1)).cast("int"))
    counts = _counts(rows)
    table_ = ratios(counts)
    scored = materialize(_scored(rows, table_, expected(counts, table_)), "quality")
    held = scored.where("fold = 1").select("kind", *KINDS[1:]).toPandas()
    clean = held[held["kind"] == "target"]
    cuts = {k: threshold(clean[k].to_numpy(), held.loc[held["kind"] == k, k].to_numpy()) for k in KINDS[1:]}
    keep = F.lit(True)
    for kind, cut in cuts.items():
        keep = keep & (F.col(kind) >= F.lit(float(cut)))
    return numbered(scored.select("doc_id", "log_weight", *KINDS[1:], keep.alias("keep")))


#: Rows of the last bin of ``gumbel_top`` that come to the driver.
LAST_BIN = 10_000


def gumbel_top(weights: DataFrame, k: int, seed: int = 5) -> DataFrame:
    """Adds selected: the k rows with the largest log_weight plus Gumbel noise drawn from a hash of doc_id.

    The k-th largest sum is found by counting ever finer bins, never by a
    global sort. Rows that tie with it are all selected, so repeated rows stay
    together. A NULL doc_id draws like any other value.
    """
    unit = (F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit(2**52 - 1)) + 0.5) / F.lit(2.0**52)
    keyed = materialize(weights.withColumn("_key", F.col("log_weight") - F.log(-F.log(unit))), "gumbel")
    n, low, high = keyed.agg(F.count(F.lit(1)), F.min("_key"), F.max("_key")).first()
    above = 0  # rows over the bin that holds the k-th
    if n <= k or k <= 0:
        return keyed.withColumn("selected", F.lit(n <= k and n > 0)).drop("_key")
    while True:
        inside = keyed.where(F.col("_key").between(low, high))
        if low == high or inside.count() <= LAST_BIN:
            break
        bins = inside.groupBy(F.least(F.floor((F.col("_key") - low) / (high - low) * 1024), F.lit(1023)).alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high")
        )
        for r in sorted(bins.collect(), key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
    if low == high:
        cut = low
    else:
        cut = sorted((r[0] for r in inside.select("_key").collect()), reverse=True)[k - above - 1]
    return keyed.withColumn("selected", F.col("_key") >= F.lit(cut)).drop("_key")


@query
def op9_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight, whether the classifier keeps it, and a sample of half the kept ones."""
    judged = materialize(classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "judged")
    kept = judged.where("keep")
    sampled = gumbel_top(kept, -(-kept.count() // 2))
    return sampled.unionByName(judged.where("NOT keep").withColumn("selected", F.lit(False)))
