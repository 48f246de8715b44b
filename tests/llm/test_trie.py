"""The prefix trie against a plain one, with blocks of several lengths."""

import hashlib
import math
import random
import re
from zlib import crc32

import pytest
from pyspark.sql import types as T

from worklens.llm import prefix_trie as pt
from worklens.llm.registry import import_in_workers

SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in ("pos", "own", "depth", "p1", "n", "k", "last", "words")],
    ]
)


@pytest.fixture
def conversations(spark):
    import_in_workers(spark)
    return lambda rows: spark.createDataFrame([(*r, *["x"] * 8) for r in rows], SCHEMA)


def brute(rows):
    conv = {}
    for c, t, r, x in rows:
        if c is not None:
            conv.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [r[2:] for r in sorted(v, key=lambda r: r[:2])] for c, v in conv.items()}
    built = {}
    for c, v in own.items():
        h = crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    nodes = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        parents = {k[:-1] for k in below if k}
        words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        ended = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(key))))
        out.append(
            (
                min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(k[:-1] == key and k != key for k in below if k),
                sum(k not in parents for k in below), sum((len(nodes[k]) - 1) * words(k) for k in below), hashlib.sha256(ended.encode()).hexdigest(),
            )
        )
    return out


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, x) for x in r])


def made(seed, n, long):
    """Few different turns, so that many beginnings are shared; some conversations are prefixes or copies of others."""
    rng = random.Random(seed)
    rows, whole = [], []
    for c in rng.sample(range(4 * n), n):
        kind = rng.random()
        if whole and kind < 0.3:
            turns = rng.choice(whole)
        elif whole and kind < 0.6:
            turns = rng.choice(whole)[: rng.randrange(long)] + [("user", rng.choice("abc"))] * rng.randrange(3)
        else:
            turns = [(rng.choice(["user", "bot"]), "w " * rng.randrange(3) + rng.choice("abcd")) for _ in range(rng.randrange(1, long))]
        if turns:
            whole.append(turns)
            rows += [(c, k, r, x) for k, (r, x) in enumerate(turns)]
    return rows


@pytest.mark.parametrize(("block", "seed", "long"), [(4, 1, 14), (1, 2, 5), (3, 3, 9), (4, 4, 30)])
def test_trie_equals_the_plain_one(conversations, block, seed, long):
    rows = made(seed, 60, long)
    got = pt.conversation_trie(conversations(rows), block).collect()
    assert order(map(tuple, got)) == order(brute(rows))


def test_odd_rows(conversations):
    rows = [
        (0, None, "user", "hello  there"), (0, 1, None, None), (0, 2, "bot", ""), (20, 0, "user", "x"), (21, 0, "user", "y"),
        (None, 0, "user", "of nobody"), (7, 5, "user", "w " * 50_000), (7, 5, "user", "w " * 50_000), (8, 0, "bot", "\t\n"), (-3, 0, "user", "minus"),
        (40, 3, None, "Ünï x"),
    ]
    got = pt.conversation_trie(conversations(rows)).collect()
    assert order(map(tuple, got)) == order(brute(rows))


def test_no_rows(conversations):
    for rows in ([], [(None, 0, "user", "x")]):
        assert pt.conversation_trie(conversations(rows)).collect() == []


def test_conversations_left_without_turns(conversations):
    """All turns go with the first h, the conversation that would lend its own is absent."""
    taken = [c for c in range(21, 400) if crc32(str(c).encode()) % 4 >= 1 and c % 20][:5]
    rows = [(c, 0, "user", "only") for c in taken]
    got = pt.conversation_trie(conversations(rows)).collect()
    assert order(map(tuple, got)) == order(brute(rows)) and len(got) == 1


def test_ids_of_a_crowded_end_go_in_pieces(conversations, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK_BYTES", 60)
    rows = [(c * 20, k, "user", f"t{k}") for c in range(200) for k in range(3)]
    got = pt.conversation_trie(conversations(rows)).collect()
    assert order(map(tuple, got)) == order(brute(rows))
