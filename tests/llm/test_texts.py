"""Tokens, packing, files, lines, fingerprints: exact round trips and brute force on odd rows."""

import hashlib
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from conftest_llm import LONG, ODD

from worklens.llm import edit_fingerprint, line_dedup, packing, token_files, tokenization
from worklens.llm.tokenization import PartEncoder, vocabulary


@pytest.fixture(scope="module")
def whole():
    encoder = PartEncoder(vocabulary())
    return lambda text, end: [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def number(ids):
    return crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_one_call(whole):
    encoder = PartEncoder(vocabulary())
    odd = ["  a  b ", "a\n\n b", "x \n y", "it's  we're 12 345", "a \x1c c", "a\tb \tc", "<|endoftext|> x", " ", "", "日本 語", "\nab c", "ab c\n", "a　b c", LONG]
    for text, got in zip(odd, encoder.encode_many(odd), strict=True):
        assert got.tolist() == whole(text, 0)[:-1]


def test_encoder_memory_is_bounded_by_bytes(whole, monkeypatch):
    """Long lines without blanks are not kept, kept parts stay under the bound, ids stay right over several spans."""
    monkeypatch.setattr(tokenization, "CACHE_BYTES", 60_000)
    monkeypatch.setattr(tokenization, "SPAN_BYTES", 5_000)
    encoder = PartEncoder(vocabulary())
    rows = ["".join(chr(97 + (i * k) % 23) for k in range(400)) + f" w{i} end" for i in range(300)]
    rows += [" ".join(f"n{i}x{k}" for k in range(200)) for i in range(20)] + ["a\u00a0 b \u2003c d\u3000 e f\u0085 g"]
    for text, got in zip(rows, encoder.encode_many(rows), strict=True):
        assert got.tolist() == whole(text, 0)[:-1]
    kept = encoder.kept
    assert 32 * len(kept.key) + 4 * len(kept.pool) <= 60_000
    assert kept.size.max() <= tokenization.KEEP_BYTES


def test_pieces_and_packing(docs, whole):
    made = packing.pieces(docs(ODD), vocabulary())
    placed = packing.pack(made, group_pieces=20).collect()
    expect = Counter()
    for i, t in ODD:
        ids = whole(t, 0)
        for k, (a, n) in enumerate(packing.cut(len(ids), 2048)):
            expect[(i, k, a, n, number(ids[a : a + n]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed) == expect
    held = defaultdict(list)
    for r in placed:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in held.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048


def test_packing_an_empty_table(docs):
    assert packing.pack(packing.pieces(docs([]), vocabulary())).collect() == []


def test_sum_of_squares_choice():
    """Every step takes a place with the least sum of squares, counted anew."""
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 21, 300)
    where, offset = packing.sum_of_squares(lengths, 20)
    used = {}

    def cost(state):
        gaps = Counter(20 - u for u in state.values() if u < 20)
        return sum(n * n for n in gaps.values())

    for n, w, o in zip(lengths.tolist(), where.tolist(), offset.tolist(), strict=True):
        options = [{**used, b: u + n} for b, u in used.items() if u + n <= 20] or [{**used, max(used, default=-1) + 1: n}]
        assert used.get(w, 0) == o
        used[w] = o + n
        assert cost(used) == min(map(cost, options))


def test_packing_is_close_to_full():
    rng = np.random.default_rng(4)
    for sizes in (rng.integers(1, 2049, 20_000), rng.integers(1, 700, 5_000)):
        where, _ = packing.sum_of_squares(-np.sort(-sizes))
        assert where.max() + 1 <= 1.005 * -(-sizes.sum() // 2048)


def test_files_round_trip(docs, whole):
    shards = token_files.write(docs(ODD), vocabulary(), shard_bytes=2_000)
    got = sorted(token_files.read(shards).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([i for i, _ in ODD if i is not None] + [None, None], key=lambda i: (i is not None, i))
    left, at = Counter((i, number(whole(t, 2)), len(whole(t, 2))) for i, t in ODD), 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        left[(r["doc_id"], r["ids_crc32"], r["n_tokens"])] -= 1
    assert not any(left.values())


def test_any_token_alone():
    rng = np.random.default_rng(6)
    ids = [rng.integers(0, 300, 900), np.zeros(0, np.int64), rng.integers(0, 2**32, 700), np.array([255, 256, 65535, 65536])]
    shard = token_files.Shard(token_files.write_shard([3, 4, 5, 6], ids))
    flat = np.concatenate(ids)
    assert shard.tokens().tolist() == flat.tolist()
    assert [shard.token(i) for i in range(len(flat))] == flat.tolist()
    assert token_files.Shard(token_files.write_shard([], [])).tokens().tolist() == []


def test_no_files_of_an_empty_table(docs):
    assert token_files.read(token_files.write(docs([]), vocabulary())).collect() == []


def test_perfect_hash():
    keys = np.random.default_rng(8).integers(0, 2**64, 5_000, dtype=np.uint64)
    function = line_dedup.PerfectHash.unpacked(line_dedup.PerfectHash(keys).packed())
    assert sorted(function.index(keys).tolist()) == list(range(len(keys)))
    assert function.index(np.zeros(0, np.uint64)).tolist() == []


def brute_lines(rows):
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(blank))
    owners = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20 and i is not None:
                owners[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(owners[key(x)]) >= 3 and len(key(x)) >= 20 and i != max(owners[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("shard_keys", [1, 100_000])
def test_lines_equal_brute_force(docs, shard_keys):
    rows = [*ODD]
    for i in range(20, 60):
        rows.append((i, "\n".join([f"  This line stands in every Document {i % 2}\t", f"only here {i} but long enough", "short", "This line stands in every document 1"])))
    rows.append((None, "this line stands in every document 1\nand a line of its own here"))
    got = line_dedup.dedup_lines(docs(rows), shard_keys=shard_keys).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == brute_lines(rows)


def test_lines_beside_clashing_names(spark):
    """Columns with the names used inside come back as they were; a long document of repeated lines takes its lines once."""
    names = ("_id", "_kept", "_gone", "_gone_id", "_missing", "row", "id", "gone", "kept", "a.b")
    long = [f"line number {i:06d} of the long text" for i in range(48_000)]
    rows = [(i, "\n".join(long if i else long + ["its own and only line here"] * 2), *[f"{n}{i}" for n in names]) for i in range(3)] + [(9, None, *["x"] * len(names))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    import time

    begun = time.time()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame).collect()}
    assert time.time() - begun < 60
    for i, text, *rest in rows:
        assert [got[i][n] for n in names] == rest and got[i]["text"] == text
    assert [got[i]["n_dropped"] for i in (0, 1, 2, 9)] == [48_000, 48_000, 0, 0]
    assert got[0]["kept_text"] == "\n".join(["its own and only line here"] * 2) and got[9]["kept_text"] == ""


def test_lines_of_an_empty_table(docs):
    assert line_dedup.dedup_lines(docs([])).collect() == []


def test_fingerprints_and_edits(docs):
    got = edit_fingerprint.compare_with_next(docs(ODD)).collect()
    assert len(got) == len(ODD)
    by_text = defaultdict(set)
    texts = {}
    for r in got:
        texts.setdefault(r["doc_id"], []).append(r)
    for i in (1, 2, 9, 10):
        text = dict(ODD)[i]
        assert texts[i][0]["n_chars"] == len(text)
        by_text[text].add(texts[i][0]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert texts[3][0]["fingerprint"] == "0" * 64 and texts[3][0]["near_edited"] == 1.0
    # 10 is followed by 9, 2 by 1; the last number is followed by what has none.
    ten, nine = dict(ODD)[10], dict(ODD)[9]
    half = len(ten) // 2
    assert texts[10][0]["edited_sha256"] == hashlib.sha256((ten[: len(ten) - half] + nine[:half]).encode()).hexdigest()
    assert texts[2][0]["near_next"] == 1.0
    assert 0.4 < texts[9][0]["near_edited"] <= 1.0


def test_one_document_follows_itself(docs):
    (r,) = edit_fingerprint.compare_with_next(docs({5: "abcdef"})).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and r["near_next"] == 1.0
    assert edit_fingerprint.compare_with_next(docs([])).collect() == []


def test_edit_distance_shows_in_likeness():
    rng = np.random.default_rng(9)
    base = rng.integers(97, 123, 3000).astype(np.uint32)
    near = np.delete(base, [500, 1700])
    other = rng.integers(97, 123, 3000).astype(np.uint32)
    a, b, c = edit_fingerprint.embed([base, near, other])
    assert edit_fingerprint.likeness([a], [b])[0] > 0.8 > 0.3 > edit_fingerprint.likeness([a], [c])[0]


def test_near_classes_by_bands(docs):
    rng = np.random.default_rng(10)
    letters = np.array(list("abcdefghij klmnop"))
    rows = {}
    for k in range(12):
        base = rng.choice(letters, 2500)
        rows[k] = "".join(base)
        rows[100 + k] = "".join(np.delete(base, [100, 900]))
        rows[200 + k] = rows[k]
    got = {r["doc_id"]: r["class_id"] for r in edit_fingerprint.near_duplicates(edit_fingerprint.fingerprints(docs(rows))).collect()}
    assert all(got[200 + k] == got[k] for k in range(12))
    assert sum(got[100 + k] == k for k in range(12)) >= 11
    assert all(got[k] == k for k in range(12))


def test_near_classes_in_a_crowded_band(spark, monkeypatch):
    """Two near fingerprints, unlike in their first signs, between many unrelated ones of the same band: against all pairs."""
    monkeypatch.setattr(edit_fingerprint, "BLOCK", 100)
    rng = np.random.default_rng(12)
    picks = sorted(np.random.default_rng(73).choice(edit_fingerprint.CELLS, 6, replace=False).tolist())
    letters = np.array(list("ACGT"))
    signs = letters[rng.integers(0, 4, (400, edit_fingerprint.CELLS))]
    for k in range(0, 40, 2):
        signs[k + 1] = signs[k]
        free = [c for c in range(edit_fingerprint.CELLS) if c not in picks][:10]
        signs[k + 1, free] = np.where(signs[k, free] == "A", "T", "A")
    signs[:, picks] = "C"
    names = rng.permutation(400).tolist()
    rows = [(n, "".join(s)) for n, s in zip(names, signs, strict=True)]
    got = {r["doc_id"]: r["class_id"] for r in edit_fingerprint.near_duplicates(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()}
    expect = {n: n for n in names}
    for i in range(400):
        for j in np.flatnonzero((signs == signs[i]).mean(axis=1) >= 0.8).tolist():
            low = min(expect[names[i]], expect[names[j]])
            expect[names[i]] = expect[names[j]] = low
    assert got == expect and sum(a != b for a, b in got.items()) == 20
