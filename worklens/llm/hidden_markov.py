"""Language-model scores by a hidden Markov model.

States emit word classes; a word stands in its class as often as in the
corpus. So P(word | state) = P(word) * theta(state, class) / P(class), with
P(word) the smoothed unigram of exact corpus counts: the score of a text is
its unigram score plus what the forward recursion says about its classes.
Short words are their own class, longer ones go by their ending, all hashed
into ``CLASSES``. A word the corpus lacks is one class of its own that every
state emits alike, so states say nothing about it.

Baum-Welch runs over all training documents: every task sums expected counts
over its texts, Spark adds them up by class, the driver normalises a table of
states by classes, whose size is fixed. For training, texts are read in
windows of ``WINDOW`` tokens, each starting from the stationary distribution
(the first one from the initial distribution); scoring runs the scaled forward
recursion over the whole text.

Words are known by 64 bits, 49 of a hash and 15 that name the class. Documents
are laid out in blocks of bounded size that hold their own small dictionary,
so counting and looking up words moves one row per word and block instead of
one per token. A block numbers its words by frequency and writes the numbers
as three compressed planes of bytes.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm.arrays import Words, encoded, mix, spans, sums
from worklens.llm.frames import numbered, share, texts
from worklens.llm.registry import query, table
from worklens.session import materialize

STATES = 8
CLASSES = 1 << 14
#: Longest word, in bytes, that is a class of its own; longer ones go by their last bytes.
WHOLE_BYTES, ENDING_BYTES = 5, 3
ROUNDS = 6
WINDOW = 256
SEED = 29
PRIOR = 0.1
#: Bytes of text in a block.
BLOCK_BYTES = 6_000_000

END_WORD = np.uint64(0xE17A1465AF8C6F05)
END_CLASS = CLASSES  # the end token
N_CLASSES = CLASSES + 1

CLASS_BITS = np.uint64(0x7FFF)

BLOCKS = "block long, doc_id binary, held_out binary, tokens binary, word binary, words array<long>, counts array<long>"


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^24 as compressed planes of their bytes."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return zlib.compress(np.ascontiguousarray(planes.T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(3, -1).astype(np.int64)
    return planes[0] | planes[1] << 8 | planes[2] << 16


def word_rows(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word of every token, its class in the low bits, the end of each text included; and where each text begins."""
    words = Words([t.lower() for t in raw])
    hashes = words.hashes()
    long_ = words.end - words.start > WHOLE_BYTES
    ending = words.hash_of(np.where(long_, words.end - ENDING_BYTES, words.start), words.end) + long_.astype(np.uint64)
    classes = (mix(ending) % np.uint64(CLASSES)).astype(np.uint16)
    at = words.first[1:]
    first = words.first + np.arange(len(words.first))
    known = (np.insert(hashes, at, END_WORD) & ~CLASS_BITS) | np.insert(classes, at, END_CLASS).astype(np.uint64)
    return known, first


def blocks(docs: DataFrame, held_out) -> DataFrame:
    """Documents laid out in blocks; ``held_out`` is a column, true for those not to learn from."""

    def lay(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw_all = encoded(batch["text"].tolist())
            ids, held_all = batch["doc_id"].to_numpy(), batch["held_out"].to_numpy(bool)
            for some in spans([len(t) for t in raw_all], BLOCK_BYTES):
                hashes, first = word_rows(raw_all[some])
                held = held_all[some]
                own, word, times = np.unique(hashes, return_inverse=True, return_counts=True)
                order = np.argsort(-times, kind="stable")
                own, word = own[order], np.argsort(order)[word]
                learned = np.repeat(~held, np.diff(first))
                yield pd.DataFrame(
                    {
                        "block": [part * 2**32 + number],
                        "doc_id": [ids[some].astype("<i8").tobytes()],
                        "held_out": [held.astype(np.uint8).tobytes()],
                        "tokens": [np.diff(first).astype("<i8").tobytes()],
                        "word": [packed(word)],
                        "words": [own.view(np.int64)],
                        "counts": [np.bincount(word[learned], minlength=len(own))],
                    }
                )
                number += 1

    return texts(docs, held_out.alias("held_out")).mapInPandas(lay, BLOCKS)


@dataclass
class Model:
    """Initial, transition and emission probabilities; emissions over classes."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def random(cls, prior: np.ndarray, states: int) -> Model:
        rng = np.random.default_rng(SEED)
        emit = prior[None, :] * rng.gamma(2.0, 1.0, (states, len(prior)))
        move = np.full((states, states), 0.1 / (states - 1)) if states > 1 else np.ones((1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))

    def stationary(self) -> np.ndarray:
        at = np.full(len(self.start), 1 / len(self.start))
        for _ in range(200):
            at = at @ self.move
        return at


class Steps:
    """Sequences side by side, longest first: step t holds token t of those that are that long."""

    def __init__(self, first: np.ndarray, size: np.ndarray):
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        self.active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
        begin = first[self.order]
        self.edge = np.concatenate([[0], np.cumsum(self.active)])
        step = np.repeat(np.arange(len(self.active)), self.active)
        row = np.arange(self.edge[-1]) - self.edge[step]
        self.token = begin[row] + step


def forward(start: np.ndarray, move: np.ndarray, ratio: np.ndarray, steps: Steps) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward variables and scales, step after step; ``start`` has a row per sequence in step order."""
    alpha = np.empty((len(steps.token), move.shape[0]), np.float32)
    scale = np.empty(len(steps.token))
    before = None
    for t, n in enumerate(steps.active.tolist()):
        here = slice(steps.edge[t], steps.edge[t] + n)
        now = (start if before is None else before[:n] @ move) * ratio[here]
        total = now.sum(axis=1)
        now /= total[:, None]
        alpha[here], scale[here] = now, total
        before = now
    return alpha, scale


def windows(first: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and whether it opens a text, of all windows of all texts."""
    lengths = np.diff(first)
    count = -(-lengths // size)
    of = np.repeat(np.arange(len(lengths)), count)
    k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][of] + k * size, np.minimum(size, lengths[of] - k * size), k == 0


#: Tokens whose forward and backward variables are held at once.
HELD_TOKENS = 400_000


def expected(model: Model, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of the texts, and their log likelihood by classes."""
    s = len(model.start)
    starts, moves, emits, loss = np.zeros(s), np.zeros((s, s)), np.zeros((N_CLASSES, s)), 0.0
    emit, still = np.ascontiguousarray(model.emit.T, np.float32), model.stationary()
    move = model.move.astype(np.float32)
    begin, size, opens = windows(first)
    for some in spans(size.tolist(), HELD_TOKENS):
        steps = Steps(begin[some], size[some])
        ratio = emit[classes[steps.token]]
        opening = opens[some][steps.order]
        start = np.where(opening[:, None], model.start, still).astype(np.float32)
        alpha, scale = forward(start, move, ratio, steps)
        loss += float(np.log(scale).sum())
        beta = np.ones((len(start), s), np.float32)
        gamma = np.empty_like(alpha)
        for t in range(len(steps.active) - 1, -1, -1):
            n = int(steps.active[t])
            here = slice(steps.edge[t], steps.edge[t] + n)
            if t + 1 < len(steps.active) and (m := int(steps.active[t + 1])):
                after = slice(steps.edge[t + 1], steps.edge[t + 1] + m)
                weight = ratio[after] * beta[:m] / scale[after, None].astype(np.float32)
                moves += alpha[steps.edge[t] : steps.edge[t] + m].T @ weight
                beta[:m] = weight @ move.T
            gamma[here] = alpha[here] * beta[:n]
        starts += gamma[: len(start)][opening].sum(axis=0)
        for k in range(s):
            emits[:, k] += np.bincount(classes[steps.token], gamma[:, k], minlength=N_CLASSES)
    return starts, moves * model.move, emits, loss


def _texts(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of every token, where texts begin, which are held out, and the number of every token's word."""
    word = unpacked(row["word"])
    classes = (np.asarray(row["words"], np.int64) & np.int64(CLASS_BITS))[word]
    first = np.concatenate([[0], np.cumsum(np.frombuffer(row["tokens"], "<i8"))])
    return classes, first, np.frombuffer(row["held_out"], np.uint8).astype(bool), word


def _learned(classes: np.ndarray, first: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.repeat(~held, np.diff(first))
    return classes[keep], np.concatenate([[0], np.cumsum(np.diff(first)[~held])])


def train(laid: DataFrame, prior: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> tuple[Model, list[float]]:
    """Baum-Welch over all blocks; also the log likelihood before each round."""
    model, history, spark = Model.random(prior, states), [], laid.sparkSession
    columns = [f"s{k}" for k in range(states)]
    schema = "kind string, place int, " + ", ".join(f"{c} double" for c in columns)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def count(batches, sent=sent):
            total = None
            for batch in batches:
                for _, row in batch.iterrows():
                    classes, first = _learned(*_texts(row)[:3])
                    got = expected(sent.value, classes, first)
                    total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
            if total is None:
                return
            starts, moves, emits, loss = total
            used = np.flatnonzero(emits.sum(axis=1))
            for kind, place, rows in (("start", [0], starts[None, :]), ("move", range(states), moves), ("emit", used, emits[used]), ("loss", [0], np.full((1, states), loss))):
                yield pd.DataFrame({"kind": kind, "place": list(place), **{c: rows[:, k] for k, c in enumerate(columns)}})

        read = laid.select("tokens", "word", "words", "held_out").mapInPandas(count, schema)
        sums_ = read.groupBy("kind", "place").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()  # states by classes at most
        part = {k: g.sort_values("place") for k, g in sums_.groupby("kind")}
        if "emit" not in part or not len(part["emit"]):
            break
        history.append(float(part["loss"]["s0"].iloc[0]))
        emits = np.zeros((N_CLASSES, states))
        emits[part["emit"]["place"].to_numpy()] = part["emit"][columns].to_numpy()
        starts, moves = part["start"][columns].to_numpy()[0] + PRIOR, part["move"][columns].to_numpy() + PRIOR
        # Every state may emit every class of the corpus: the prior is the corpus itself.
        emits = emits.T + states * prior[None, :]
        model = Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True))
        sent.unpersist()
    return model, history


def score_blocks(placed: DataFrame, model: Model, prior: np.ndarray, n: int, v: int) -> DataFrame:
    """Scores from blocks joined with the corpus counts of their words (index and count side by side)."""
    # A class without words in training is never asked for: its words are unknown.
    ratios = np.divide(model.emit, prior[None, :], out=np.ones_like(model.emit), where=prior[None, :] > 0)
    sent = placed.sparkSession.sparkContext.broadcast((np.ascontiguousarray(ratios.T), model.start, model.move))

    def run(batches):
        ratio_of, start, move = sent.value
        for batch in batches:
            for _, row in batch.iterrows():
                classes, first, held, word = _texts(row)
                count = np.zeros(len(row["words"]))
                if row["known_at"] is not None and len(row["known_at"]):
                    count[np.asarray(row["known_at"], np.int64)] = np.asarray(row["known_c"], np.int64)
                base = np.log10((count + PRIOR) / (n + PRIOR * (v + 1)))
                gain = np.zeros(len(first) - 1)
                for some in spans(np.diff(first).tolist(), HELD_TOKENS):
                    steps = Steps(first[some.start : some.stop], np.diff(first)[some])
                    ratio = ratio_of[classes[steps.token]]
                    ratio[count[word[steps.token]] == 0] = 1.0
                    _, scale = forward(np.broadcast_to(start, (len(steps.order), len(start))), move, ratio, steps)
                    row_of = np.arange(len(steps.token)) - np.repeat(steps.edge[:-1], steps.active)
                    own = np.zeros(len(steps.order))
                    own[steps.order] = np.bincount(row_of, np.log10(scale), minlength=len(steps.order))
                    gain[some] = own
                lower = sums(base[word], first)
                yield pd.DataFrame(
                    {
                        "doc_id": np.frombuffer(row["doc_id"], "<i8"),
                        "held_out": held,
                        "n_tokens": np.diff(first),
                        "n_known": sums(count[word] > 0, first).round().astype(np.int64),
                        "train_tokens": n,
                        "base_score": lower,
                        "score": lower + gain,
                    }
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return placed.mapInPandas(run, schema)


def score_documents(docs: DataFrame, held_out, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    A missing or empty text is one end token. Without training documents every
    word is unknown and both scores are equal. Repeated rows count and score
    once each.
    """
    laid = materialize(blocks(docs, held_out), "blocks")
    pairs = laid.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).where("w.counts > 0")
    counts = materialize(pairs.groupBy(F.col("w.words").alias("h")).agg(F.sum("w.counts").alias("c")), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # The mass of a class is that of its smoothed words, so P(word) / P(class) is a distribution.
    prior = np.zeros(N_CLASSES)
    for r in counts.groupBy(F.col("h").bitwiseAND(F.lit(int(CLASS_BITS))).alias("class")).agg(F.sum(F.col("c") + PRIOR).alias("n")).collect():
        prior[r["class"]] = r["n"]
    prior = prior / prior.sum() if n else prior
    model = train(laid, prior, rounds)[0] if n else Model.random(np.full(N_CLASSES, 1 / N_CLASSES), STATES)
    known = (
        laid.select("block", F.posexplode("words").alias("at", "h"))
        .join(counts, "h")
        .groupBy("block")
        .agg(F.collect_list(F.struct("at", "c")).alias("k"))  # at most the words of one block
        .select("block", F.col("k.at").alias("known_at"), F.col("k.c").alias("known_c"))
    )
    placed = laid.select("block", "doc_id", "held_out", "tokens", "word", "words").join(known, "block", "left")
    return numbered(score_blocks(placed, model, prior, int(n), int(v)))


@query
def op2_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's unigram and hidden Markov score, learned from nine tenths of them."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, F.coalesce(share(F.col("doc_id"), 10) == 0, F.lit(False)))
