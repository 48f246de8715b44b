"""Scores, classifiers, decontamination and chunks: brute force, held-out accuracy and odd rows."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from conftest_llm import LONG, ODD
from pyspark.sql import functions as F

from worklens.llm import chunk_dedup, decontamination, hidden_markov, language, quality
from worklens.llm.frames import share


def held(frame):
    return F.coalesce(share(F.col("doc_id"), 10) == 0, F.lit(False))


def test_unigram_part_equals_brute_force(docs):
    got = hidden_markov.score_documents(docs(ODD), held(None), rounds=2).collect()
    assert len(got) == len(ODD)
    words = lambda t: [*(t or "").encode().lower().split(), None]
    known = Counter()
    for i, t in ODD:
        if i is None or crc32(str(i).encode()) % 10:
            known.update(words(t))
    n, v = sum(known.values()), len(known)
    expect = Counter()
    for i, t in ODD:
        base = sum(math.log10((known[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))
        expect[(i, len(words(t)), sum(known[w] > 0 for w in words(t)), n, round(base, 4))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == expect
    assert all(math.isfinite(r["score"]) for r in got)
    assert hidden_markov.score_documents(docs([]), held(None)).collect() == []


def test_forward_sums_all_paths():
    """The scaled recursion gives the probability summed over every path of states."""
    rng = np.random.default_rng(3)
    s, sizes = 3, [1, 4, 6]
    start, move = rng.dirichlet(np.ones(s)), rng.dirichlet(np.ones(s), s)
    emit = rng.random((sum(sizes), s))
    first = np.concatenate([[0], np.cumsum(sizes)])
    steps = hidden_markov.Steps(first[:-1], np.array(sizes))
    _, scale = hidden_markov.forward(np.broadcast_to(start, (3, s)), move, emit[steps.token], steps)
    row = np.arange(len(steps.token)) - np.repeat(steps.edge[:-1], steps.active)
    got = np.bincount(row, np.log(scale))
    for k, text in enumerate(steps.order):
        total = 0.0
        for path in np.ndindex(*[s] * sizes[text]):
            p = start[path[0]] * emit[first[text], path[0]]
            for t in range(1, sizes[text]):
                p *= move[path[t - 1], path[t]] * emit[first[text] + t, path[t]]
            total += p
        assert math.isclose(got[k], math.log(total), rel_tol=1e-6)


def test_training_raises_the_likelihood_and_beats_the_unigram(docs):
    rng = random.Random(1)
    kinds = [[f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]]
    rows = {i: " ".join(rng.choices(kinds[i % 2], k=60)) for i in range(200)}
    made = docs(rows)
    laid = hidden_markov.blocks(made, held(None)).persist()
    prior = np.full(hidden_markov.N_CLASSES, 1 / hidden_markov.N_CLASSES)
    _, history = hidden_markov.train(laid, prior, 4)
    assert history == sorted(history)
    got = hidden_markov.score_documents(made, held(None)).where("held_out").collect()
    assert got and all(r["score"] > r["base_score"] for r in got)


def test_emissions_are_a_distribution(docs):
    """Summed over all known words, P(word | state) is what the unknown word leaves."""
    rows = {i: f"alpha beta{i % 3} gammas{i % 5}" for i in range(30)}
    counts = Counter(w for i, t in rows.items() for w in [*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    known, _ = hidden_markov.word_rows([" ".join(w for w in counts if w).encode()])
    class_of = dict(zip([*[w for w in counts if w], None], (known & hidden_markov.CLASS_BITS).tolist(), strict=True))
    prior = np.zeros(hidden_markov.N_CLASSES)
    for w, c in counts.items():
        prior[class_of[w]] += c + 0.1
    prior /= prior.sum()
    model = hidden_markov.Model.random(prior, 4)
    total = sum((c + 0.1) / (n + 0.1 * (v + 1)) * model.emit[:, class_of[w]] / prior[class_of[w]] for w, c in counts.items())
    assert np.allclose(total, 1 - 0.1 / (n + 0.1 * (v + 1)))


ITEM = "measure how quickly seven green engines cross the wide valley before the third bell rings over the sleeping town and count them"


def test_benchmark_copies(spark, docs):
    rng = random.Random(2)
    filler = lambda: " ".join(rng.choices(["and", "of", "the", "house", "tree", "runs", "cloud", "seven", "over"], k=80))
    words = ITEM.split()
    edited = [*words[:6], "blue", *words[7:15], *words[16:], "quickly"]
    rows = {
        1: filler() + " " + ITEM + " " + filler(),
        2: filler() + " " + " ".join(edited).upper() + "! " + filler(),
        3: filler(),
        4: " ".join(words[:5]) + " " + filler(),
        5: f"{ITEM}\n{filler()}\n{ITEM}",
    }
    bench = spark.createDataFrame([(70, ITEM), (71, None), (72, ""), (73, "two words"), (None, ITEM), (70, ITEM)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.contamination(docs([*rows.items(), *ODD]), bench).collect()}
    assert set(got) == {(1, 70), (2, 70), (5, 70)}
    assert got[1, 70] == got[5, 70] == 1.0 and 0.6 < got[2, 70] < 1.0
    assert decontamination.contamination(docs([]), bench).collect() == []
    assert decontamination.contamination(docs(rows), bench.where("false")).collect() == []


@pytest.mark.parametrize("original", [False, True])
def test_evenly_edited_copies(spark, docs, original):
    """Every fifth or sixth word changed, without six unbroken words of the item in the corpus or beside the original."""
    rng = random.Random(4)
    filler = lambda: " ".join(f"f{rng.randrange(5000)}" for _ in range(80))
    items = {i: [f"i{i}w{k}" for k in range(40)] for i in range(12)}
    rows = {}
    for i, words in items.items():
        near = [f"e{i}x{k}" if k % (5 + i % 2) == 2 else w for k, w in enumerate(words)]
        rows[i] = f"{filler()} {' '.join(near)} {filler()}"
        rows[100 + i] = f"{filler()} {' '.join(words)} {filler()}" if original else filler()
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contamination(docs(rows), bench).collect()}
    assert got == {(i, i) for i in items} | ({(100 + i, i) for i in items} if original else set())


def test_alignment_equals_the_plain_recursion():
    rng = np.random.default_rng(5)
    items = [rng.integers(0, 4, n).astype(np.uint64) << np.uint64(2) for n in (3, 9, 14)]
    stretches = [rng.integers(0, 4, n).astype(np.uint64) << np.uint64(2) for n in (8, 20, 5)]
    score, _, _ = decontamination.align(items, stretches)
    for a, b, s in zip(items, stretches, score.tolist(), strict=True):
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                step = decontamination.MATCH if a[i - 1] == b[j - 1] else decontamination.MISMATCH
                h[i, j] = max(0, h[i - 1, j - 1] + step, h[i - 1, j] + decontamination.GAP, h[i, j - 1] + decontamination.GAP)
        assert s == h.max()


def quality_rows(n=600):
    rng = random.Random(7)
    plain = [f"plain{i}" for i in range(300)]
    rows, labels = {}, []
    for i in range(n):
        words = rng.choices(plain, k=60)
        poor, toxic = i % 5 == 1, i % 5 == 2
        if toxic:
            for bad in rng.choices(["nasty", "vile", "awful"], k=3):
                words[rng.randrange(60)] = bad
        rows[i] = " ".join(w + "###" for w in words) if poor else " ".join(words)
        if i % 2:
            labels.append((i, 0 if poor else 1, int(toxic)))
    return rows, labels


def test_classifier_on_unlabelled_rows(spark, docs):
    rows, labels = quality_rows()
    table = spark.createDataFrame([*labels, (None, 1, 0), (9_999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs([*rows.items(), *ODD]), table).collect()
    assert len(got) == len(rows) + len(ODD)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] > 10 and r["doc_id"] % 2 == 0:
            assert r["keep"] == (r["doc_id"] % 5 not in (1, 2))


def test_long_clean_documents_are_kept(spark, docs):
    """Clean texts say a telling word now and then: a long one is as clean as the short ones it is made of."""
    rng = random.Random(9)
    plain, bad = [f"plain{i}" for i in range(300)], ["nasty", "vile", "awful", "grim", "foul", "rank"]

    def text(words, harsh):
        return " ".join(rng.choice(bad) if rng.random() < harsh else rng.choice(plain) for _ in range(words))

    rows = {i: text(60, 0.1 if i % 4 == 1 else 0.003) for i in range(800)}
    long = {1_000 + i: text(20_000, 0.003) for i in range(6)} | {2_000 + i: text(20_000, 0.1) for i in range(6)}
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs(rows | long), labels).collect()}
    assert all(got[1_000 + i] for i in range(6)) and not any(got[2_000 + i] for i in range(6))


def test_classifier_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["keep"] for r in quality.classify(docs(ODD), none).collect())
    assert quality.classify(docs([]), none).collect() == []


@pytest.mark.parametrize("k", [0, 1, 37, 500, 900])
def test_gumbel_top_is_the_k_largest(spark, monkeypatch, k):
    monkeypatch.setattr(quality, "LAST_BIN", 10)
    frame = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("double").alias("log_weight"))
    got = quality.gumbel_top(frame, k)
    unit = (F.xxhash64("doc_id", F.lit(5)).bitwiseAND(F.lit(2**52 - 1)) + 0.5) / F.lit(2.0**52)
    keys = {r[0]: r[1] for r in frame.select("doc_id", F.col("log_weight") - F.log(-F.log(unit))).collect()}
    assert {r["doc_id"] for r in got.where("selected").collect()} == set(sorted(keys, key=keys.get)[::-1][:k])


def test_language_held_out_accuracy(spark, docs):
    rng = random.Random(11)
    parts = {"aa": ["tion", "the", "ing"], "bb": ["keit", "ung", "sch"], "cc": ["eux", "ment", "que"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(25)), lang) for i, lang in enumerate(rng.choices(list(parts), k=300))]
    table = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 ... 456", "bb"), (902, "", "cc"), (903, "tion", None), (None, "the ing", "aa")], "doc_id long, text string, lang string")
    model = language.train(table.where(share(F.col("doc_id"), 4) != 2))
    got = {r["doc_id"]: r for r in language.predict(table, model).collect()}
    assert len(got) == 305
    apart = [(i, lang) for i, _, lang in rows if crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == lang for i, lang in apart) >= 0.98 * len(apart)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0.0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_without_training_rows(docs):
    made = docs(ODD)
    model = language.train(made.where("false"))
    assert {r["lang_pred"] for r in language.predict(made, model).collect()} == {"und"}
    assert language.predict(docs([]), model).collect() == []


def test_long_passages_are_found_and_cut(docs):
    rng = random.Random(13)
    fresh = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n))
    passage = fresh(80)
    rows = {1: f"{fresh(50)} {passage} {fresh(40)}", 2: f"{fresh(33)} {passage} {fresh(20)}", 3: f"{fresh(7)}\n{passage}", 4: fresh(200), 5: None, 6: "", 7: LONG}
    made = docs([*rows.items(), (None, passage)])
    found = chunk_dedup.repeated_passages(made)
    got = {r["doc_id"]: r for r in found.collect()}
    assert {2, 3} <= set(got) <= {2, 3, 7}
    for i in (2, 3):
        cut = rows[i].encode()[got[i]["start"] : got[i]["start"] + got[i]["size"]].decode()
        assert cut in passage and got[i]["words"] >= 40 and got[i]["kept_in"] == 1
    after = {r["doc_id"]: r["text"] for r in chunk_dedup.without_passages(made, found).collect()}
    assert after[1] == rows[1] and after[4] == rows[4] and after[5] is None and len(after[2]) < len(rows[2]) - 300
    assert chunk_dedup.repeated_passages(docs([])).collect() == []


def test_chunks_met_in_many_places_are_no_passage(docs):
    """A fresh text whose every chunk is known from another document, no eight words in a row from one."""
    rng = random.Random(19)
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(300)]
    text = " ".join(words).encode()
    chunks = chunk_dedup.Chunks([text])
    parts = [text[a : a + n].decode() for a, n in zip(chunks.start.tolist(), chunks.size.tolist(), strict=True)]
    rows = {}
    for i, part in enumerate(parts):
        # The cut at a chunk's two ends depends on the bytes before them: the word before goes along.
        before = parts[i - 1].split()[-2:] if i else []
        rows[i] = " ".join([f"q{i}r{rng.randrange(10**6)}" for _ in range(9)] + before + [part] + [f"s{i}t{rng.randrange(10**6)}" for _ in range(9)])
    rows[1000] = text.decode()
    rows[1001] = f"{rows[1000]} and more"
    far = {i for i, part in enumerate(parts) if len(part.split()) >= 6}
    got = {r["doc_id"]: r for r in chunk_dedup.repeated_passages(docs({i: t for i, t in rows.items() if i not in far})).collect()}
    assert set(got) == {1001} and got[1001]["kept_in"] == 1000 and got[1001]["words"] >= 290


def test_cuts_move_only_near_an_insertion():
    rng = random.Random(17)
    words = [f"w{rng.randrange(10**5)}" for _ in range(400)]
    one = chunk_dedup.Chunks([" ".join(words).encode()])
    two = chunk_dedup.Chunks([" ".join([*words[:200], "inserted", *words[200:]]).encode()])
    assert len(set(one.digest.tolist()) - set(two.digest.tolist())) <= 4


def test_repeated_rows_are_one_document(docs):
    text = " ".join(f"z{i}" for i in range(100))
    assert chunk_dedup.repeated_passages(docs([(1, text), (1, text)])).collect() == []
    rows = chunk_dedup.repeated_passages(docs([(1, text), (2, text), (2, text)])).collect()
    assert [(r["doc_id"], r["kept_in"]) for r in rows] == [(2, 1)] and rows[0]["words"] == 100
