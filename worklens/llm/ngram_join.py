"""Jaccard join of documents over word n-grams by groups of equal prefixes.

Two sets link when 100 * intersection >= 80 * union. Shingles are put in one
order, rare ones first; linked sets share one of their first shingles, the
prefix. Sets of one size with the same prefix are one group, and groups stand
for their members while candidates are sought (Bouros, Ge and Mamoulis, PVLDB
2012): one row per group and prefix shingle.

* Groups that share a prefix shingle meet under it; sizes and places drop
  pairs of groups that cannot link.
* What is left is expanded to members and verified. A profile, the counts of
  a set's shingles in a few cells, bounds how much two sets differ and drops
  most false pairs without reading the sets; the whole sets decide the rest.

Equal sets are one member. Links serve to find classes, so pairs whose ends
are already in one class need no look: first come all pairs of few groups, the
neighbours inside a group and, in a crowded bucket, a spanning tree over the
profiles; then every pair that still lies between two classes, in blocks.
Nothing is left out, and a family of copies costs about its size.

How often a shingle occurs is known by a fixed table of cells that shingles
share by hash. It sets the order alone, and any order finds all links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from worklens.llm.arrays import Words, encoded, mix, ngrams, spans
from worklens.llm.components import components
from worklens.llm.frames import NO_NUMBER, numbered, texts, whole_groups
from worklens.llm.registry import query, table
from worklens.session import materialize

WORDS = 5
LEAST = 80  # percent
#: Cells of the table of shingle counts, and cells a row of it holds.
COUNTED, PART = 1 << 20, 1 << 12
#: Up to so many groups under one shingle give all their pairs at once.
SMALL = 16
#: Members compared with each other in one task.
BLOCK = 2048
#: Buckets a member joins for the first trees: its most crowded ones.
CROWDED = 2
#: Shingles a cell of a profile holds on average, fewest cells, and cells of the short form that buckets compare.
CELL, FEWEST, SHORT = 16, 64, 64
#: Bits of the map of members whose sets are wanted.
WANTED = 1 << 23


def overlap(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Smallest intersection of linked sets of these sizes: 100 i >= least (a + b - i)."""
    return -(-least * (a + b) // (100 + least))


def prefix_size(size: np.ndarray | int, least: int) -> np.ndarray | int:
    """Shingles of which a linked set must share one: all but as many as the smallest intersection, plus one."""
    return size - -(-least * size // 100) + 1


def profile(shingles: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles by cell; the number of cells is a power of two that follows the set's size."""
    cells = FEWEST
    while cells * CELL < len(shingles):
        cells *= 2
    return np.bincount((shingles >> np.uint64(32)).astype(np.int64) % cells, minlength=cells).astype(np.int32)


def folded(counts: np.ndarray, cells: int) -> np.ndarray:
    return counts.reshape(-1, cells).sum(axis=0)


def shorts(profiles: pd.Series) -> np.ndarray:
    """Profiles folded to ``SHORT`` cells, a row each."""
    return np.array([folded(np.frombuffer(x, "<i4"), SHORT) for x in profiles], np.int64).reshape(-1, SHORT)


def may_link(difference: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Whether sets of sizes a and b that differ in at least so many shingles can link."""
    return difference <= a + b - 2 * overlap(a, b, least)


def _sets(batch: pd.DataFrame):
    """Numbers and shingle sets of a batch, a span of text at a time."""
    rows, ids = batch["text"].tolist(), batch["doc_id"].to_numpy()
    for some in spans([len(t) for t in rows]):
        yield ids[some], shingle_sets(Words([t.lower() for t in encoded(rows[some])]), WORDS)


def shingle_sets(words: Words, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle, one without words none."""
    hashes = words.hashes()
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        out.append(np.unique(ngrams(hashes[a:b], min(n, b - a))) if b > a else np.zeros(0, np.uint64))
    return out


def _digest(numbers: np.ndarray) -> int:
    """One number for a sequence of hashes, whatever its length."""
    place = np.arange(1, len(numbers) + 1, dtype=np.uint64)
    return int(np.sum(mix(numbers + mix(place)), dtype=np.uint64).view(np.int64))


def described(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, member, size, profile) of every text, and how many texts hold a shingle of each cell."""

    def run(batches):
        total = np.zeros(COUNTED, np.int32)
        for batch in batches:
            for ids, sets in _sets(batch):
                cells, n = np.unique(np.concatenate(sets) % np.uint64(COUNTED), return_counts=True)
                total[cells.astype(np.int64)] += n.astype(np.int32)
                yield pd.DataFrame(
                    {"kind": 0, "doc_id": ids, "member": [_digest(s) for s in sets], "size": [len(s) for s in sets], "data": [profile(s).astype("<i4").tobytes() for s in sets]}
                )
        parts = total.reshape(-1, PART)
        some = np.flatnonzero(parts.any(axis=1))
        yield pd.DataFrame({"kind": 1, "doc_id": 0, "member": some, "size": 0, "data": [parts[i].tobytes() for i in some]})

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, n in zip(batch["member"].tolist(), batch["data"], strict=True):
                held[part] = held.get(part, 0) + np.frombuffer(n, np.int32).astype(np.int64)
        yield pd.DataFrame({"part": list(held), "n": [n.tobytes() for n in held.values()]})

    made = materialize(rows.mapInPandas(run, "kind int, doc_id long, member long, size int, data binary"), "join-texts", ("kind",))
    counts = np.zeros((COUNTED // PART, PART), np.int64)
    for r in made.where("kind = 1").select("member", "data").repartition("member").mapInPandas(merge, "part long, n binary").collect():
        counts[r["part"]] = np.frombuffer(r["n"], np.int64)
    return made.where("kind = 0").select("doc_id", "member", "size", F.col("data").alias("profile")), counts.reshape(-1)


def prefixes(rows: DataFrame, counts: np.ndarray, least: int) -> DataFrame:
    """(shingle, group, member, size, place): the rarest shingles of every set, in order."""
    sent = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for batch in batches:
            for _, sets in _sets(batch):
                sets = [s for s in sets if len(s)]
                firsts, groups = [], []
                for s in sets:
                    rare = np.lexsort((s, sent.value[(s % np.uint64(COUNTED)).astype(np.int64)]))[: prefix_size(len(s), least)]
                    firsts.append(s[rare])
                    groups.append(_digest(np.append(firsts[-1], np.uint64(len(s)))))
                if not sets:
                    continue
                times = [len(f) for f in firsts]
                yield pd.DataFrame(
                    {
                        "shingle": np.concatenate(firsts).view(np.int64),
                        "group": np.repeat(groups, times),
                        "member": np.repeat([_digest(s) for s in sets], times),
                        "size": np.repeat([len(s) for s in sets], times),
                        "place": np.concatenate([np.arange(n) for n in times]),
                    }
                )

    return rows.mapInPandas(run, "shingle long, group long, member long, size int, place int")


def _possible(size: np.ndarray, place: np.ndarray, other_size: np.ndarray, other_place: np.ndarray, least: int) -> np.ndarray:
    """Whether sets can link if the shingle at these places is the first they share."""
    return np.minimum(size - place, other_size - other_place) >= overlap(size, other_size, least)


def _frame(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _edges(frame: pd.DataFrame, key: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of every group of sorted rows."""
    edge = np.ones(len(frame), bool)
    edge[1:] = (frame[key].iloc[1:].to_numpy() != frame[key].iloc[:-1].to_numpy()).any(axis=1)
    first = np.flatnonzero(edge)
    return first, np.diff(np.append(first, len(frame)))


def few(buckets: DataFrame, least: int) -> DataFrame:
    """Pairs of groups under shingles that at most ``SMALL`` groups share."""
    small = SMALL

    def run(batches):
        for frame in whole_groups(batches, ["shingle"]):
            shingle, group, size, place = (frame[c].to_numpy(np.int64) for c in ("shingle", "group", "size", "place"))
            out = []
            for gap in range(1, min(small, len(frame))):
                at = np.flatnonzero(shingle[gap:] == shingle[:-gap])
                at = at[_possible(size[at], place[at], size[at + gap], place[at + gap], least)]
                out.append((group[at], group[at + gap]))
            yield _frame(out)

    ordered = buckets.select("shingle", "group", "size", "place").repartition("shingle").sortWithinPartitions("shingle", "group")
    return ordered.mapInPandas(run, "a long, b long").distinct()


def _tree(member: np.ndarray, size: np.ndarray, place: np.ndarray, short: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs that can link, nearest profiles first (Prim)."""
    n = len(member)
    best, link = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    left = np.ones(n, bool)
    out, now = [], 0
    for _ in range(n - 1):
        left[now] = False
        rest = np.flatnonzero(left)
        gap = np.abs(short[rest] - short[now]).sum(axis=1)
        ok = may_link(gap, size[rest], size[now], least) & _possible(size[rest], place[rest], size[now], place[now], least) & (gap < best[rest])
        best[rest[ok]], link[rest[ok]] = gap[ok], now
        now = int(rest[best[rest].argmin()])
        if link[now] >= 0:
            out.append((link[now], now))
    a, b = (np.array(x, np.int64) for x in (zip(*out, strict=True) if out else ((), ())))
    return member[a], member[b]


def trees(buckets: DataFrame, profiles: DataFrame, least: int) -> DataFrame:
    """Pairs that connect crowded buckets, one block of members at a time."""
    rank = F.row_number().over(W.partitionBy("member").orderBy(F.col("n").desc(), "shingle"))
    chosen = buckets.where(F.col("n") > SMALL).withColumn("r", rank).where(F.col("r") <= CROWDED)
    own = F.pmod(F.xxhash64("member", "shingle"), F.ceil(F.col("n") / BLOCK)).cast("int")
    dealt = chosen.select("shingle", own.alias("block"), "member", "size", "place").join(profiles.select("member", "profile"), "member")
    key = ["shingle", "block"]

    def run(batches):
        for frame in whole_groups(batches, key):
            member, size, place = (frame[c].to_numpy(np.int64) for c in ("member", "size", "place"))
            short = shorts(frame["profile"])
            first, count = _edges(frame, key)
            yield _frame([_tree(*(x[i : i + n] for x in (member, size, place, short)), least) for i, n in zip(first.tolist(), count.tolist(), strict=True)])

    ordered = dealt.repartition(*key).sortWithinPartitions(*key, "member")
    return ordered.mapInPandas(run, "a long, b long").distinct()


def between(buckets: DataFrame, profiles: DataFrame, least: int) -> DataFrame:
    """All pairs of members of different classes that share a prefix shingle and can link, two blocks at a time."""
    own = F.pmod(F.xxhash64("member"), F.col("k")).cast("int")
    other = F.explode(F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda x: x != F.col("own"))))
    dealt = (
        buckets.withColumn("k", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("own", own)
        .join(profiles.select("member", "profile"), "member")
        .select("*", other.alias("other"))
        .select("shingle", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "member", "size", "place", "label", "profile")
    )
    key = ["shingle", "i", "j"]

    def run(batches):
        for frame in whole_groups(batches, key):
            member, size, place, label = (frame[c].to_numpy(np.int64) for c in ("member", "size", "place", "label"))
            short = shorts(frame["profile"])
            out, held = [], 0
            for i, n in zip(*map(np.ndarray.tolist, _edges(frame, key)), strict=True):
                part = np.arange(i, i + n)
                # One end of every such pair is outside the largest class of the bucket.
                names, index, times = np.unique(label[part], return_inverse=True, return_counts=True)
                largest = names[times.argmax()]
                for x in part[label[part] != largest].tolist():
                    rest = part[(label[part] != label[x]) & ((label[part] == largest) | (part > x))]
                    rest = rest[_possible(size[rest], place[rest], size[x], place[x], least)]
                    rest = rest[may_link(np.abs(short[rest] - short[x]).sum(axis=1), size[rest], size[x], least)]
                    out.append((np.full(len(rest), member[x]), member[rest]))
                    held += len(rest)
                    if held > 200_000:
                        yield _frame(out)
                        out, held = [], 0
            yield _frame(out)

    ordered = dealt.repartition(*key).sortWithinPartitions(*key, "member")
    return ordered.mapInPandas(run, "a long, b long").distinct()


def _bit(member: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return (mix(member.view(np.uint64) + mix(doc_id.view(np.uint64))) % np.uint64(WANTED)).astype(np.int64)


def wanted(ends: DataFrame) -> np.ndarray:
    """A map of ``WANTED`` bits, set for the texts (member, doc_id) that have to show their sets."""
    width = WANTED // 256

    def run(batches):
        held = np.zeros(WANTED, bool)
        for batch in batches:
            held[_bit(batch["member"].to_numpy(np.int64), batch["doc_id"].to_numpy(np.int64))] = True
        parts = held.reshape(256, width)
        some = np.flatnonzero(parts.any(axis=1))
        yield pd.DataFrame({"part": some, "bits": [np.packbits(parts[i]).tobytes() for i in some]})

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, bits in zip(batch["part"].tolist(), batch["bits"], strict=True):
                held[part] = held.get(part, 0) | np.frombuffer(bits, np.uint8)
        yield pd.DataFrame({"part": list(held), "bits": [b.tobytes() for b in held.values()]})

    out = np.zeros((256, width // 8), np.uint8)
    for r in ends.mapInPandas(run, "part int, bits binary").repartition("part").mapInPandas(merge, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def verified(found: DataFrame, rows: DataFrame, profiles: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) that link: by their profiles first, then by their whole sets."""

    def near(batches):
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            sizes = zip(batch["left_size"].tolist(), batch["right_size"].tolist(), strict=True)
            for i, (x, y, (m, n)) in enumerate(zip(batch["left"], batch["right"], sizes, strict=True)):
                x, y = np.frombuffer(x, "<i4"), np.frombuffer(y, "<i4")
                cells = min(len(x), len(y))
                ok[i] = may_link(np.abs(folded(x, cells) - folded(y, cells)).sum(), m, n, least)
            yield batch.loc[ok, ["a", "b"]]

    side = lambda end, name: profiles.select(F.col("member").alias(end), F.col("profile").alias(name), F.col("size").alias(f"{name}_size"))
    pairs = found.where("a <> b").join(side("a", "left"), "a").join(side("b", "right"), "b")
    pairs = materialize(pairs.mapInPandas(near, "a long, b long"), "join-pairs")
    ends = pairs.select(F.col("a").alias("member")).unionByName(pairs.select(F.col("b").alias("member"))).distinct()
    ends = materialize(ends.join(profiles.select("member", "doc_id"), "member"), "join-ends")
    sent = rows.sparkSession.sparkContext.broadcast(wanted(ends))

    def sets(batches):
        """Sets of the texts that the map names: all that are wanted, and few others."""
        for batch in batches:
            for ids, all_ in _sets(batch):
                member = np.array([_digest(s) for s in all_], np.int64)
                bit = _bit(member, ids.astype(np.int64))
                asked = np.flatnonzero(sent.value[bit // 8] >> (7 - bit % 8).astype(np.uint8) & 1)
                yield pd.DataFrame({"member": member[asked], "doc_id": ids[asked], "shingles": [all_[i].tobytes() for i in asked.tolist()]})

    held = rows.mapInPandas(sets, "member long, doc_id long, shingles binary").join(ends, ["member", "doc_id"], "left_semi")
    held = materialize(held.dropDuplicates(["member"]).select("member", "shingles"), "join-sets")

    def link(batches):
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch["left"], batch["right"], strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= least * (len(x) + len(y) - both)
            yield batch.loc[ok, ["a", "b"]]

    whole = lambda end, name: held.select(F.col("member").alias(end), F.col("shingles").alias(name))
    return materialize(pairs.join(whole("a", "left"), "a").join(whole("b", "right"), "b").mapInPandas(link, "a long, b long"), "join-links")


def inside(groups: DataFrame) -> DataFrame:
    """Neighbours among the members of a group."""

    def run(batches):
        last = None
        for batch in batches:
            batch = batch if last is None else pd.concat([last, batch], ignore_index=True)
            last = batch.iloc[-1:]
            group, member = batch["group"].to_numpy(np.int64), batch["member"].to_numpy(np.int64)
            at = np.flatnonzero(group[1:] == group[:-1])
            yield _frame([(member[at], member[at + 1])])

    return groups.repartitionByRange("group", "member").sortWithinPartitions("group", "member").mapInPandas(run, "a long, b long")


def ngram_join(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Words are runs without blanks, A-Z lower-cased; a document's set holds its
    distinct five-word shingles, a shorter text is one shingle. A missing text
    or one without words has the empty set, links with nothing and is its own
    component. Rows without a number have a set size and no component, and link
    nothing. Rows that share a number are looked at one by one, each in the
    class of its own text. Only doc_id and text are read, other columns cannot
    clash. A very long text is one row whose set stays within its task. An
    empty table gives no rows.
    """
    rows = texts(docs)
    described_, counts = described(rows)
    known = rows.where(F.col("doc_id") != NO_NUMBER)
    named = described_.where((F.col("doc_id") != NO_NUMBER) & (F.col("size") > 0))
    profiles = named.groupBy("member").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("profile").alias("profile"))
    profiles = materialize(profiles, "join-members")

    # Most shingles are in one text alone: only shared ones go on, each member once.
    first = materialize(prefixes(known, counts, least), "join-prefixes")
    shared = first.groupBy("shingle").agg(F.min("member").alias("low"), F.max("member").alias("high")).where("low <> high").select("shingle")
    buckets = materialize(first.join(materialize(shared, "join-shared"), "shingle", "left_semi").distinct(), "join-buckets")
    crowd = buckets.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    members = buckets.select("group", "member").distinct()
    several = materialize(members.groupBy("group").agg(F.count(F.lit(1)).alias("m"), F.min("member").alias("stands")).where("m > 1").drop("m"), "join-groups")
    buckets = buckets.join(crowd, "shingle").join(several, "group", "left").withColumn("stands", F.coalesce("stands", "member"))
    buckets = materialize(buckets, "join-bucket-members")

    single = buckets.where(F.col("member") == F.col("stands")).withColumn("group", F.col("member"))
    found = few(single.where(F.col("n") <= SMALL), least)
    found = found.unionByName(trees(buckets, profiles, least)).unionByName(inside(members.join(several, "group", "left_semi")))
    links = verified(materialize(found.distinct(), "join-candidates"), known, profiles, least)
    classes = components(links, "a", "b")

    labelled = buckets.join(classes.withColumnRenamed("node", "member"), "member", "left")
    labelled = materialize(labelled.withColumn("label", F.coalesce("component", "member")).drop("component"), "join-labels")
    facts = labelled.groupBy("shingle").agg(
        F.max("n").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.col("member") != F.col("stands")).alias("expanded")
    )
    # Buckets of few lone members have given all their pairs.
    left = facts.where((F.col("low") != F.col("high")) & ((F.col("n") > SMALL) | F.col("expanded"))).select("shingle")
    left = materialize(left, "join-open")
    if not left.isEmpty():
        more = materialize(between(labelled.join(left, "shingle", "left_semi"), profiles, least), "join-more")
        if not more.isEmpty():
            links = links.unionByName(verified(more, known, profiles, least))
            classes = components(links, "a", "b")

    placed = profiles.select("member", F.col("doc_id").alias("least_id")).join(classes.withColumnRenamed("node", "member"), "member", "left")
    placed = materialize(placed.select("member", "least_id", F.coalesce("component", "member").alias("label")), "join-placed")
    heads = placed.groupBy("label").agg(F.min("least_id").alias("component_id"))
    placed = materialize(placed.join(heads, "label").select("member", "component_id"), "join-classes")
    out = described_.select("doc_id", "member", F.col("size").cast("long").alias("n_shingles")).join(placed, "member", "left")
    component = F.when(F.col("doc_id") == NO_NUMBER, F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return numbered(out.select("doc_id", "n_shingles", component.alias("component_id")))


_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ 	-
]+') AS words FROM documents),
x AS (SELECT DISTINCT doc_id, list_aggregate(list_slice(words, i, i + 4), 'string_agg', ' ') AS s
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.seen) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


@query(sql=_SQL)
def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and class of linked documents."""
    return ngram_join(table(spark, sf_dir, "documents"))
