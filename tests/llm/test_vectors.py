"""Vector codes against a plain version, on odd rows and on one entry that takes most rows."""

import hashlib
import math

import pytest
from pyspark.sql import types as T

from worklens.llm import vector_codes as vc
from worklens.llm.registry import import_in_workers

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        *[T.StructField(c, T.StringType()) for c in ("row", "part", "entry", "position", "salt", "code", "moved")],
    ]
)


@pytest.fixture
def vectors(spark):
    import_in_workers(spark)
    return lambda rows: spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA)


def brute(rows, positions=8, entries=16, rounds=6):
    kept = []
    for i, v, label in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(4096 * x) for x in v], label))
    width = len(min((r for r in kept if r[0] is not None), key=lambda r: r[:2])[1]) // positions
    kept = [r for r in kept if len(r[1]) == width * positions]
    seeds = {}
    for i, v, _ in sorted(r[:2] + (0,) for r in kept if r[0] is not None):
        seeds.setdefault(i, v)
    seeds = [seeds[i] for i in sorted(seeds)[:entries]]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in seeds] for p in range(positions)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            held = [[] for _ in book]
            for _, v, _ in kept:
                held[nearest(cut(v, p), book)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(h) for c in zip(*h, strict=True)] if h else e for h, e in zip(held, book, strict=True)]
    out = []
    for i, v, label in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(positions)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return out, digest


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, x) for x in r])


def made(n, rng):
    rows = []
    for i in range(n):
        centre = rng.choice([-0.5, 0.0, 0.25, 0.7])
        # A third of all rows is one vector.
        v = [0.125] * 16 if i % 3 == 0 else [centre + rng.uniform(-0.2, 0.2) for _ in range(16)]
        rows.append((i, v, rng.choice([None, 0, 1])))
    return rows


@pytest.mark.parametrize("owner", [1000, 7])
def test_codes_equal_the_plain_version(vectors, monkeypatch, owner):
    import random

    import numpy as np

    monkeypatch.setattr(vc, "OWNER_MEMBERS", owner)
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in made(300, random.Random(4))]
    coded, codebook = vc.vector_codes(vectors(rows))
    expect, digest = brute(rows)
    assert order(tuple(r) for r in coded.collect()) == order(expect)
    assert vc.codebook_digest(codebook) == digest


def test_odd_rows(vectors):
    ok = [0.5, -0.25] * 4
    rows = [
        (5, ok, 1), (5, ok, 1), (5, [0.25] * 8, 1), (None, [0.75] * 8, None), (3, [0.5] * 8, 2), (9, [1.0] * 16, 2), (8, [0.5] * 7, 2),
        (1, None, 1), (2, [0.5, None] * 4, 1), (4, [float("nan")] * 8, 1), (6, [float("inf")] * 8, 1), (7, [], 1), (10, [3e38] + [0.0] * 7, 1),
    ]
    coded, codebook = vc.vector_codes(vectors(rows))
    got = coded.collect()
    assert sorted((r["vec_id"] is None, r["vec_id"]) for r in got if r["vec_id"] is not None) == [(False, i) for i in (3, 5, 5, 5, 10)]
    assert sum(r["vec_id"] is None for r in got) == 1 and codebook.shape == (8, 3, 1)
    assert all(len(r["code"]) == 16 and r["error"] >= 0 for r in got)


def test_no_rows(vectors):
    for rows in ([], [(1, None, 1)], [(None, [0.5] * 8, 1)]):
        coded, _ = vc.vector_codes(vectors(rows))
        assert coded.collect() == [] and coded.columns == ["vec_id", "label", "code", "error"]


def test_only_movers_travel(vectors, monkeypatch):
    """Rounds after the first shuffle fewer members than there are."""
    import random

    sent = []
    plain = vc.materialize

    def seen(frame, name, *rest):
        out = plain(frame, name, *rest)
        if name == "vector-movers":
            sent.append(out.count())
        return out

    monkeypatch.setattr(vc, "materialize", seen)
    vc.vector_codes(vectors(made(400, random.Random(6))))
    assert sent[0] == 400 * 8 and all(n < 400 * 4 for n in sent[1:])
