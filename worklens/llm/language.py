"""Language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its character n-grams, hashed into
buckets; a linear softmax reads the language from it (Joulin et al., EACL
2017). Embeddings and softmax are trained together by stochastic gradient
descent in NumPy on a bounded sample of labelled documents. A temperature
fitted on rows kept apart makes the scores match how often they are right, and
scores below the accepted level are marked as rejected.

For prediction, embedding and softmax are multiplied out into one table of
bucket by language, so a text costs one look-up per n-gram; whole texts are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm.arrays import spans
from worklens.llm.frames import numbered, share, texts
from worklens.llm.registry import query, table
from worklens.session import materialize

BUCKETS = 1 << 15
DIMENSIONS = 16
GRAMS = (1, 2, 3)
#: Labelled documents used, chosen by a hash of their number; the last fifth calibrates.
SAMPLE = 5_000
EPOCHS, RATE, SEED = 8, 0.5, 17
#: Least share of right answers among accepted calibration rows.
PRECISION = 0.99

_KEYS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def grams(texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram that starts at each character, and the text it belongs to.

    One row per length n; an n-gram that would leave its text has bucket ``BUCKETS``.
    """
    low = [t.lower() for t in texts_]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(t) for t in low], np.int64)
    owner = np.repeat(np.arange(len(low)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters to the end of the text
    out = np.full((len(GRAMS), len(codes)), BUCKETS, np.int64)
    total = np.zeros(len(codes), np.uint64)
    for k, n in enumerate(GRAMS):
        if len(codes) < n:
            break
        total[: len(codes) - n + 1] += (codes[n - 1 :] + np.uint64(n)) * _KEYS[k]
        mixed = (total ^ (total >> np.uint64(29))) * _KEYS[1]
        out[k] = np.where(left >= n, (mixed >> np.uint64(49)).astype(np.int64), BUCKETS)
    return out, owner


def bags(texts_: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their counts of every text."""
    found, owner = grams(texts_)
    keys = (owner[None, :] * (BUCKETS + 1) + found)[found < BUCKETS]
    keys, counts = np.unique(keys, return_counts=True)
    of, bucket = keys // (BUCKETS + 1), keys % (BUCKETS + 1)
    edge = np.searchsorted(of, np.arange(len(texts_) + 1))
    return [(bucket[a:b], counts[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


class Model:
    """Embedding by bucket, softmax, temperature and accepted level."""

    def __init__(self, languages: list[str]):
        rng = np.random.default_rng(SEED)
        self.languages = languages
        self.embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
        self.weight = np.zeros((DIMENSIONS, len(languages)))
        self.bias = np.zeros(len(languages))
        self.temperature, self.accepted = 1.0, 0.0

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        steps, done = EPOCHS * len(rows), 0
        for _ in range(EPOCHS):
            for i in rng.permutation(len(rows)).tolist():
                bucket, count = rows[i]
                rate = RATE * (1 - done / steps)
                done += 1
                if not len(bucket):
                    continue
                part = count / count.sum()
                hidden = part @ self.embedding[bucket]
                error = softmax((hidden @ self.weight + self.bias)[None, :])[0]
                error[labels[i]] -= 1
                back = self.weight @ error
                self.weight -= rate * np.outer(hidden, error)
                self.bias -= rate * error
                # The average spreads a step thin over many buckets; it is scaled to the largest share.
                self.embedding[bucket] -= rate * np.outer(part / part.max(), back)

    def logits(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(rows), len(self.languages)))
        for i, (bucket, count) in enumerate(rows):
            if len(bucket):
                out[i] = (count / count.sum()) @ self.embedding[bucket] @ self.weight
        return out + self.bias

    def calibrate(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        """Temperature with the least log loss, then the lowest score from which answers are right often enough."""
        if not len(rows):
            return
        logits = self.logits(rows)
        grid = np.geomspace(0.05, 20, 121)
        losses = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(rows)), labels], 1e-12)).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(losses))])
        probability = softmax(logits / self.temperature)
        score, right = probability.max(1), probability.argmax(1) == labels
        order = np.argsort(-score)
        good = np.cumsum(right[order]) / np.arange(1, len(rows) + 1) >= PRECISION
        self.accepted = float(score[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0

    def folded(self) -> np.ndarray:
        """Language scores by bucket, with a row of zeros for n-grams that are none."""
        return np.concatenate([self.embedding @ self.weight, np.zeros((1, len(self.languages)))]).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from (doc_id, text, lang) rows, at most ``sample`` of them."""
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    chosen = known.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample)
    rows = known.join(F.broadcast(materialize(chosen, "language-sample")), "doc_id")  # at most ``sample`` pairs of numbers

    def describe(batches):
        for batch in batches:
            some = batch["text"].tolist()
            for part in spans([len(t) for t in some], 1_000_000):
                bag = bags(some[part])
                yield pd.DataFrame(
                    {
                        "h": batch["h"].to_numpy()[part],
                        "lang": batch["lang"].to_numpy()[part],
                        "bucket": [b.astype("<i4").tobytes() for b, _ in bag],
                        "count": [c.astype("<i4").tobytes() for _, c in bag],
                    }
                )

    got = rows.select("h", "lang", "text").mapInPandas(describe, "h long, lang string, bucket binary, count binary")
    # A number that repeats in the table brings all its rows; order and cut make the sample the same every time.
    bag = got.orderBy("h", "lang", F.xxhash64("bucket", "count")).limit(sample).toPandas()
    languages = sorted(bag["lang"].unique())
    model = Model(languages)
    pairs = [(np.frombuffer(b, "<i4"), np.frombuffer(c, "<i4")) for b, c in zip(bag["bucket"], bag["count"], strict=True)]
    labels = np.array([languages.index(x) for x in bag["lang"]], np.int64)
    apart = len(pairs) - len(pairs) // 5
    if languages:
        model.fit(pairs[:apart], labels[:apart])
        model.calibrate(pairs[apart:], labels[apart:])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every row.

    ``und`` with score 0 where the text is missing or has no letter, or nothing
    was learned; else always a learned language, ``accepted`` or not.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.folded(), model.bias, model.temperature, model.accepted, model.languages))

    def run(batches):
        folded, bias, temperature, accepted, languages = sent.value
        for batch in batches:
            rows, letters = batch["text"].tolist(), batch["letters"].to_numpy(bool)
            for some in spans([len(t) for t in rows], 2_000_000):
                part = rows[some]
                if not languages:
                    yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[some], "lang_pred": "und", "score": 0.0, "accepted": False})
                    continue
                found, owner = grams(part)
                edge = np.searchsorted(owner, np.arange(len(part) + 1))
                total = np.zeros((len(part), len(languages)))
                for row in found:
                    for k in range(len(languages)):
                        upto = np.concatenate([[0], np.cumsum(folded[:, k][row], dtype=np.float64)])
                        total[:, k] += upto[edge[1:]] - upto[edge[:-1]]
                size = np.diff(edge)
                n = sum(np.maximum(0, size - (g - 1)) for g in GRAMS)
                probability = softmax((total / np.maximum(n, 1)[:, None] + bias) / temperature)
                score, known = probability.max(1), letters[some] & (n > 0)
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].to_numpy()[some],
                        "lang_pred": np.where(known, np.array(languages, object)[probability.argmax(1)], "und"),
                        "score": np.where(known, score, 0.0),
                        "accepted": known & (score >= accepted),
                    }
                )

    rows = texts(docs, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInPandas(run, "doc_id long, lang_pred string, score double, accepted boolean")


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(share(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs.where(~held))
    found = numbered(predict(docs, model))
    return found.select("doc_id", F.coalesce(share(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
