import itertools
import random

import numpy as np
import xxhash
from conftest_llm import ODD

from worklens.llm import simhash
from worklens.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    rows = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    votes = [sum(xxhash.xxh64_intdigest(r, 42) >> b & 1 for r in rows) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(rows))


def closed(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_odd_rows(docs):
    got = simhash.simhash_components(docs(ODD)).collect()
    assert len(got) == len(ODD)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    for i, t in ODD:
        assert (i, f"{brute_fingerprint(t):016x}") in by
    assert {c for (i, _), c in by.items() if i in (1, 2)} == {1}
    assert {c for (i, _), c in by.items() if i in (3, 4, 5)} == {3}


def test_empty_table(docs):
    assert simhash.simhash_components(docs([])).collect() == []


def test_components_equal_brute_force(docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, base = {}, []
    for i in range(160):
        text = rng.choices(words, k=120) if i % 4 == 0 or not base else list(rng.choice(base))
        if i % 4:
            text[rng.randrange(len(text))] = rng.choice(words)
        base.append(text)
        rows[i * 3] = " ".join(text)
    prints = {i: brute_fingerprint(t) for i, t in rows.items()}
    linked = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    expect = closed(prints, linked)
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(docs(rows)).collect()}
    assert got == expect and len(set(expect.values())) < len(expect)


def test_large_bucket_is_cut_and_whole(spark, docs, monkeypatch):
    """A dense family in one bucket, above the sizes of blocks and of small groups."""
    monkeypatch.setattr(simhash, "BLOCK", 50)
    rng = np.random.default_rng(1)
    prints = {0}
    while len(prints) < 300:
        prints.add(int(rng.choice(list(prints))) ^ (1 << int(rng.integers(0, 16))))
    names = {p: i for i, p in enumerate(sorted(prints))}
    nodes = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for p, i in names.items()], "node long, fp binary")
    found = simhash.links(nodes)
    linked = [(names[a], names[b]) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 3]
    got = {r["node"]: r["component"] for r in components(found, "a", "b").collect()}
    assert got == {n: c for n, c in closed(names.values(), linked).items() if n in got}
    assert len(got) == 300


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
