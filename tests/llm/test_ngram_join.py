"""The grouped prefix join against all pairs."""

import itertools
import random

import pytest
from conftest_llm import LONG, ODD

from worklens.llm import ngram_join as nj


def brute(rows):
    sets = {}
    for i, t in rows.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in rows}
    linked = [(a, b) for a, b in itertools.combinations(rows, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return {i: (len(sets[i]), label[i]) for i in rows}, linked


def found(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


def family(rng, start, n, words, edits, length=60):
    base = [f"f{start}w{k}" for k in range(length)]
    rows = {start: " ".join(base)}
    for i in range(1, n):
        text = list(base)
        for _ in range(rng.randrange(1, edits + 1)):
            text[rng.randrange(length)] = rng.choice(words)
        rows[start + i] = " ".join(text)
    return rows


def made(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = {}
    for i in range(60):  # small families, short texts, block edits
        rows |= family(rng, 100 * i, rng.randrange(1, 5), words, 3, rng.choice([3, 5, 6, 9, 40, 120]))
    shared = " ".join(f"passage{k}" for k in range(60))
    for i in range(40):  # one passage in many texts that are not alike
        rows[10_000 + i] = " ".join(rng.choices(words, k=30)) + " " + shared + " " + " ".join(rng.choices(words, k=rng.randrange(20)))
    for i in range(12):  # almost all of it shared
        rows[11_000 + i] = shared + " " + " ".join(rng.choices(words, k=rng.randrange(12)))
    return rows


@pytest.mark.parametrize(("small", "block"), [(16, 2048), (2, 8)])
def test_classes_equal_all_pairs(docs, monkeypatch, small, block):
    monkeypatch.setattr(nj, "SMALL", small)
    monkeypatch.setattr(nj, "BLOCK", block)
    rows = made(3) | family(random.Random(8), 20_000, 70, [f"z{i}" for i in range(40)], 2)
    expect, linked = brute(rows)
    assert len(linked) > 150
    assert found(nj.ngram_join(docs(rows))) == expect


def test_members_of_one_prefix(docs):
    """Sets of one size that differ only in frequent shingles have equal prefixes and are told apart by the whole sets."""
    rng = random.Random(5)
    common = [" ".join(f"c{j}x{k}" for k in range(5)) for j in range(30)]
    rows = {i: "\n".join(rng.sample(common, 12)) for i in range(150)}
    own = [" ".join(f"own{k}" for k in range(40))] * 3 + [" ".join(f"mine{k}" for k in range(90))] * 3
    rows |= {1000 + i: o + " " + " ".join(f"c{j}x{k}" for j in rng.sample(range(30), 2) for k in range(5)) for i, o in enumerate(own * 6)}
    expect, _ = brute(rows)
    assert found(nj.ngram_join(docs(rows))) == expect


def test_odd_rows(docs):
    got = sorted(nj.ngram_join(docs(ODD)).collect(), key=str)
    assert len(got) == len(ODD)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert by[(1, 10)] == by[(2, 10)] == 1
    assert by[(3, 0)] == 3 and by[(4, 0)] == 4 and by[(5, 0)] == 5
    assert by[(8, 1)] == 8 and by[(7, 1)] == 7
    assert {i for i, n in by if n > 1000} == {9} and len(LONG.split()) > 1000


def test_no_rows(docs):
    assert nj.ngram_join(docs([])).collect() == []
    got = nj.ngram_join(docs([(1, None), (2, " ")])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 0, 2)]


def test_profiles_never_drop_a_link():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 4000))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = int(len(a) * rng.uniform(0, 0.2))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(n * rng.uniform(0, 0.1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            x, y = nj.profile(a), nj.profile(b)
            cells = min(len(x), len(y))
            assert nj.may_link(np.abs(nj.folded(x, cells) - nj.folded(y, cells)).sum(), len(a), len(b), 80)
            x, y = nj.folded(x, nj.SHORT), nj.folded(y, nj.SHORT)
            assert nj.may_link(np.abs(x - y).sum(), len(a), len(b), 80)


def test_families_of_one_edit(docs):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    base = [rng.choices(words, k=200) for _ in range(6)]
    rows = {i: " ".join(b) for i, b in enumerate(base)}
    for i, b in enumerate(base):
        for k in range(4):  # one word of 200: similarity over 0.9
            near = list(b)
            near[17 * (k + 2)] = "other"
            rows[10 + 10 * i + k] = " ".join(near)
        far = list(b)
        for at in range(0, 200, 8):  # similarity far below 0.8
            far[at] = "changed"
        rows[100 + i] = " ".join(far)
    got = {r["doc_id"]: r["component_id"] for r in nj.ngram_join(docs(rows)).collect()}
    assert got == {i: i if i < 6 or i >= 100 else (i - 10) // 10 for i in rows}


def test_block_edits_near_the_threshold(docs):
    """Appended, cut off and replaced blocks at shingle similarity 0.8 to 0.95, against all pairs."""
    rng = random.Random(11)
    rows = {}
    for i in range(60):
        base = [f"t{i}w{k}" for k in range(400)]
        more = [f"t{i}n{k}" for k in range(400)]
        alike = (0.80, 0.82, 0.85, 0.90, 0.95)[i % 5]
        if i % 3 == 0:
            near = base + more[: int(396 / alike) - 396]
        elif i % 3 == 1:
            near = base[: int(396 * alike) + 5]
        else:
            n = int(396 * (1 - alike) / (1 + alike)) - 4
            at = rng.randrange(0, 400 - n)
            near = base[:at] + more[:n] + base[at + n :]
        rows |= {2 * i: " ".join(base), 2 * i + 1: " ".join(near)}
    expect, linked = brute(rows)
    assert len(linked) >= 55
    assert found(nj.ngram_join(docs(rows))) == expect


def test_links_behind_a_text_that_only_looks_near(docs, monkeypatch):
    """Texts 1 and 2 are near and meet only where the shorter text 0 may be near to both, and is not."""
    monkeypatch.setattr(nj, "SMALL", 2)
    run = lambda name, n: [f"{name}{k}" for k in range(n)]
    core, passage, other = run("core", 104), run("passage", 64), run("other", 69)
    rows = {0: other + run("z", 1) + core, 1: passage + run("x", 14) + core, 2: passage + run("y", 14) + core}
    for k in range(10):
        rows |= {10 + k: passage + run(f"p{k}w", 300), 30 + k: other + run(f"o{k}w", 300)}
    got = {r["doc_id"]: r["component_id"] for r in nj.ngram_join(docs({i: " ".join(w) for i, w in rows.items()})).collect()}
    assert got == {i: i for i in rows} | {2: 1}
