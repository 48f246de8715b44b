"""Prefix trie of conversations by fixed-length block hashing.

A conversation is cut into blocks of a few turns, and conversations are grouped
by the digest of all turns up to each block's end: one row a block instead of
one a turn. Where all that go on from a place take the same next block, the
nodes inside that block are a plain chain and are read off the group. Only
where siblings diverge is the block opened and its turns grouped one by one,
and then once for each distinct block, not for each conversation.

Equal conversations are one sequence. A sequence's owner is its smallest
conv_id, and a node belongs to its smallest member. Down a sequence, once it
owns a node it owns all below, so one number per sequence, the depth ``own``
from which it owns its path, gives parents, children, leaves and tokens as
sums over a node's sequences. No walk over levels, no list of members.

A place is known by two 64-bit hashes: for each, the exclusive or of one hash
per (depth, turn), so a running sum over a conversation gives all of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from worklens.llm.registry import query, table
from worklens.session import materialize

BLOCK = 4
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a list of numbers handed on in one row.
CHUNK_BYTES = 100_000


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a1, a2, words) of every turn, in order: a missing turn number first, equal ones by content."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    hashed = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(role, text).alias("a1"),
        F.xxhash64(F.lit("second"), text, role).alias("a2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "a1", "a2")
    return hashed.withColumn("pos", F.row_number().over(order)).select("conv_id", "pos", "a1", "a2", "words")


def rebuilt(own: DataFrame, every: int = 20, parts: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share opening turns, and all conv_ids.

    Conversation c gets the first h turns of conversation c - c % every, then
    its own after its first h; h is crc32 of c as text, modulo ``parts``.
    """
    ids = own.select("conv_id").distinct()
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % parts
    heads = ids.select("conv_id", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base")).where("h > 0")
    first = own.where((F.col("conv_id") % every == 0) & (F.col("pos") < parts)).withColumnRenamed("conv_id", "base")
    opening = heads.join(first, "base").where("pos <= h").select("conv_id", F.lit(0).alias("part"), "pos", "a1", "a2", "words")
    rest = own.where(F.col("pos") > taken).select("conv_id", F.lit(1).alias("part"), "pos", "a1", "a2", "words")
    order = W.partitionBy("conv_id").orderBy("part", "pos")
    return opening.unionByName(rest).withColumn("pos", F.row_number().over(order)).drop("part"), ids


def _ends(lasts: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) of the conv_ids that end at a place, ascending and joined by commas.

    Ids are dealt by range, so a place where many end is joined in many tasks;
    the digest, one stream by nature, reads the joined pieces in order.
    """

    def join(batches):
        step = CHUNK_BYTES // 20
        for batch in batches:
            p1, p2, number = (batch[c].to_numpy(np.int64) for c in ("p1", "p2", "conv_id"))
            edge = np.ones(len(batch), bool)
            edge[1:] = (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
            start = np.flatnonzero(edge)
            ids, at, joined = list(map(str, number.tolist())), [], []
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(batch)], strict=True):
                for i in range(a, b, step):
                    at.append(i)
                    joined.append(",".join(ids[i : min(i + step, b)]))
            yield pd.DataFrame({"p1": p1[at], "p2": p2[at], "first": number[at], "ids": joined})

    def digest(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for p1, p2, ids in zip(batch["p1"].tolist(), batch["p2"].tolist(), batch["ids"], strict=True):
                if (p1, p2) == key:
                    sha.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (p1, p2), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["p1", "p2", "ends_sha256"]).astype({"p1": np.int64, "p2": np.int64})
        if key is not None:
            yield pd.DataFrame([(*key, sha.hexdigest())], columns=["p1", "p2", "ends_sha256"])

    dealt = lasts.select("p1", "p2", "conv_id").repartitionByRange("p1", "p2", "conv_id").sortWithinPartitions("p1", "p2", "conv_id")
    pieces = dealt.mapInPandas(join, "p1 long, p2 long, first long, ids string")
    ordered = pieces.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first")
    return ordered.mapInPandas(digest, "p1 long, p2 long, ends_sha256 string")


def _suffix(from_: Column) -> Column:
    """Words of a block's turns from a place in it."""
    return F.aggregate(F.filter("turns", lambda t: t["pos"] >= from_), F.lit(0).cast("long"), lambda s, t: s + t["words"])


def prefix_trie(sequences: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for every distinct beginning of (conv_id, pos, a1, a2, words) sequences.

    ``ids`` are all conv_ids, those without turns included. No ids give no
    rows. conv_id must not be NULL.
    """
    along = W.partitionBy("conv_id").orderBy("pos")
    whole = W.partitionBy("conv_id")
    places = sequences.withColumns(
        {
            "p1": F.bit_xor(F.xxhash64("a1", "a2", "pos")).over(along),
            "p2": F.bit_xor(F.xxhash64(F.lit("second"), "a2", "a1", "pos")).over(along),
            "rest": F.sum("words").over(whole) - F.sum("words").over(along),
            "size": F.count(F.lit(1)).over(whole),
        }
    )
    places = materialize(places.select("conv_id", "pos", "p1", "p2", "words", "rest", "size"), "trie-places")
    lasts = places.where("pos = size")
    ends = _ends(lasts)
    sequence = lasts.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("copies"), F.min("conv_id").alias("conv_id"))
    silent = ids.join(lasts.select("conv_id"), "conv_id", "left_anti")
    total = ids.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).first()
    quiet = silent.agg(F.count(F.lit(1)).alias("n")).first()["n"]

    # One row for every sequence and block.
    turn = F.struct("pos", "p1", "p2", "words")
    blocks = (
        places.join(sequence.select("conv_id", "copies"), "conv_id")
        .withColumn("k", F.floor((F.col("pos") - 1) / block).cast("int"))
        .groupBy("conv_id", "k")
        .agg(
            F.array_sort(F.collect_list(turn)).alias("turns"),
            F.max(F.struct("pos", "p1", "p2", "rest")).alias("end"),
            F.first("copies").alias("copies"),
            F.first("size").alias("size"),
        )
        .select("conv_id", "k", "turns", "copies", "size", "end.pos", "end.p1", "end.p2", "end.rest")
        .withColumn("last", F.col("pos") == F.col("size"))
    )
    blocks = materialize(blocks, "trie-blocks")
    groups = blocks.groupBy("p1", "p2").agg(
        F.sum("copies").alias("n"),
        F.count(F.lit(1)).alias("different"),
        F.min("conv_id").alias("owner"),
        F.sum(F.when(F.col("last"), F.col("copies")).otherwise(0)).alias("ended"),
    )
    down = W.partitionBy("conv_id").orderBy("k")
    before = lambda c, root: F.coalesce(F.lag(c).over(down), F.lit(root).cast("long"))
    path = blocks.drop("turns").join(groups, ["p1", "p2"]).withColumns(
        {
            "owner_before": before("owner", total["conv_id"]),
            # Fewer than go on from the block's start: its siblings diverge.
            "diverges": F.col("n") < before("n", total["n"]) - before("ended", quiet),
            "mine": F.col("owner") == F.col("conv_id"),
        }
    )
    path = path.withColumn("first_mine", F.col("mine") & ~F.coalesce(F.lag("mine").over(down), F.lit(False)))
    path = materialize(path, "trie-path")

    # The sequence that owns a group stands for it: turns of diverging blocks meet once per distinct block.
    opened = materialize(
        path.where("mine AND diverges").join(blocks.select("conv_id", "k", "turns"), ["conv_id", "k"])
        .select("conv_id", "k", "n", "different", "pos", "first_mine", "last", F.explode("turns").alias("t"))
        .select("conv_id", "k", "n", "different", F.col("pos").alias("end"), "first_mine", "last", "t.*"),
        "trie-opened",
    )
    nodes = opened.groupBy("p1", "p2").agg(F.sum("different").alias("different"), F.min("conv_id").alias("owner"))
    seen = opened.join(nodes.withColumnRenamed("different", "there"), ["p1", "p2"])
    # In the block where a sequence comes to own its path: its first own place, and the owner of the place before.
    inside = seen.groupBy("conv_id", "k").agg(
        F.min(F.when(F.col("owner") == F.col("conv_id"), F.col("pos"))).alias("own"),
        F.max_by("owner", F.when(F.col("owner") != F.col("conv_id"), F.col("pos"))).alias("other"),
        F.max(F.when(F.col("last") & (F.col("pos") == F.col("end")), F.col("there"))).alias("there"),
    )
    facts = path.where("mine").join(inside, ["conv_id", "k"], "left").select(
        "conv_id",
        # A sequence that others go on from in the middle of a block may own its block and no place in it.
        F.when(F.col("first_mine"), F.when(F.col("diverges"), F.col("own")).otherwise(F.col("k") * block + 1)).alias("own"),
        F.when(F.col("first_mine"), F.coalesce("other", "owner_before")).alias("above"),
        # Nobody goes on from its end.
        F.when(F.col("last") & (F.coalesce("there", "different") == 1), F.lit(1)).alias("leaf"),
    )
    facts = facts.groupBy("conv_id").agg(F.max("own").alias("own"), F.max("above").alias("above"), F.max("leaf").alias("leaf"))
    own_place = places.select("conv_id", F.col("pos").alias("own"), (F.col("words") + F.col("rest")).alias("own_words"))
    facts = materialize(facts.join(own_place, ["conv_id", "own"]), "trie-facts")

    # Sums over a group's sequences; those that never own a place have no own_words.
    late = F.col("own").isNull() | (F.col("own") > F.col("pos"))
    goes_on = (F.col("size") > F.col("pos")) & (F.col("own") <= F.col("pos") + 1)
    summed = path.select("conv_id", "k", "p1", "p2", "pos", "size", "copies", "rest").join(facts, "conv_id", "left").groupBy("p1", "p2").agg(
        F.sum(F.col("copies") * F.col("rest")).alias("below"),
        F.sum(F.when(late, F.coalesce("own_words", F.lit(0))).otherwise(0)).alias("late"),
        F.sum(F.when(goes_on, 1).otherwise(0)).alias("next"),
        F.sum(F.coalesce("leaf", F.lit(0))).alias("leaves"),
    )
    groups = (
        path.where("mine")
        .join(blocks.select("conv_id", "k", "turns"), ["conv_id", "k"])
        .join(facts.select("conv_id", "own", "above"), "conv_id", "left")
        .join(summed, ["p1", "p2"])
        .select("conv_id", "n", "diverges", "own", "above", "below", "late", "next", "leaves", F.col("rest").alias("own_rest"), F.col("pos").alias("end"), "turns")
        .withColumn("t", F.explode("turns"))
    )
    at = F.col("t.pos")
    every = groups.select(
        "diverges",
        "n",
        "leaves",
        F.col("t.p1").alias("p1"),
        F.col("t.p2").alias("p2"),
        at.cast("long").alias("depth"),
        "conv_id",
        F.when(at > F.col("own"), F.col("conv_id")).otherwise(F.col("above")).alias("above"),
        F.when(at == F.col("end"), F.col("next")).when(F.col("own") <= at + 1, 1).otherwise(0).alias("children"),
        # Words of all members from here on, less those of every distinct node once.
        (
            F.col("below")
            + F.col("n") * _suffix(at)
            - F.col("late")
            - F.when(F.col("own").isNull(), 0).otherwise(F.col("own_rest") + _suffix(F.greatest(at, F.col("own"))))
        ).alias("saved"),
    )
    least = F.min(F.struct("conv_id", "above"))
    together = every.where("diverges").groupBy("p1", "p2").agg(
        F.first("depth").alias("depth"),
        least.alias("o"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
    )
    columns = ["p1", "p2", "conv_id", "depth", "above", "n", "children", "leaves", "saved"]
    trie = every.where("NOT diverges").select(columns).unionByName(together.select("p1", "p2", "o.*", "depth", "n", "children", "leaves", "saved").select(columns))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    trie = trie.join(ends, ["p1", "p2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))

    nothing = F.lit(0).cast("long")
    top = sequence.join(facts, "conv_id", "left").join(places.where("pos = 1").select("conv_id", (F.col("words") + F.col("rest")).alias("all")), "conv_id")
    sums = top.agg(
        F.coalesce(F.sum(F.when(F.col("own") <= 1, 1)), nothing).alias("children"),
        F.coalesce(F.sum("leaf"), nothing).alias("leaves"),
        F.coalesce(F.sum(F.col("copies") * F.col("all") - F.coalesce("own_words", nothing)), nothing).alias("saved"),
    )
    ended = _ends(silent.select("conv_id", nothing.alias("p1"), nothing.alias("p2"))).first()
    root = sums.where(F.lit(total["n"] > 0)).select(
        F.lit(total["conv_id"]).cast("long").alias("conv_id"),
        nothing.alias("depth"),
        F.lit(None).cast("long").alias("above"),
        F.lit(total["n"]).cast("long").alias("n"),
        "children",
        # A trie of the root alone has one leaf.
        F.greatest("leaves", F.lit(1)).alias("leaves"),
        "saved",
        (F.lit(ended["ends_sha256"]) if ended else empty).alias("ends_sha256"),
    )
    both = trie.drop("p1", "p2").unionByName(root)
    return both.select(
        "conv_id",
        "depth",
        F.col("above").alias("parent_conv_id"),
        F.col("n").cast("long").alias("n_convs"),
        F.col("children").cast("long").alias("n_children"),
        F.col("leaves").cast("long").alias("n_leaves"),
        F.col("saved").cast("long").alias("saved_tokens"),
        "ends_sha256",
    )


def conversation_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of rebuilt conversations, one row a node.

    Missing role or text counts as empty, a missing turn number comes first,
    turns with one number stand in an order given by their content, repeated
    rows are turns of their own. Rows without conv_id belong to no conversation
    and are left out. Texts are hashed whole before anything moves, so their
    length does not matter. An empty table gives no rows. Only conv_id, turn,
    role and text are read, other columns cannot clash.
    """
    own = materialize(turns(conversations.select("conv_id", "turn", "role", "text")), "turns")
    return prefix_trie(*rebuilt(own), block)


_SQL = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, CAST(3988292384 AS BIGINT) * (c & 1)) END) AS c FROM ids),
h AS (SELECT conv_id, xor(c, CAST(4294967295 AS BIGINT)) % 4 AS h FROM crc),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT h.conv_id, 0 AS part, o.pos, o.role, o.text FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20 AND o.pos <= h.h
    UNION ALL SELECT o.conv_id, 1, o.pos, o.role, o.text FROM o JOIN h USING (conv_id) WHERE o.pos > h.h),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS pos, {'role': role, 'text': text} AS t,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
s AS (SELECT ids.conv_id, coalesce(q.seq, []) AS seq, coalesce(q.words, []) AS words FROM ids
    LEFT JOIN (SELECT conv_id, list(t ORDER BY pos) AS seq, list(words ORDER BY pos) AS words FROM n GROUP BY conv_id) q USING (conv_id)),
m AS (SELECT conv_id, d, list_slice(seq, 1, d) AS key, list_slice(seq, 1, d - 1) AS up, len(seq) AS size, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w
    FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM s)),
g AS (SELECT d, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = d) AS ended FROM m GROUP BY d, key),
k AS (SELECT a.d, a.key, count(b.d) AS children FROM g a LEFT JOIN g b ON b.d = a.d + 1 AND b.up = a.key GROUP BY a.d, a.key),
u AS (SELECT a.d, a.key, count(*) FILTER (WHERE kb.children = 0) AS leaves, sum((b.n - 1) * b.w) AS saved
    FROM g b JOIN k kb ON kb.d = b.d AND kb.key = b.key, LATERAL (SELECT unnest(range(0, b.d + 1)) AS d) x
    JOIN g a ON a.d = x.d AND a.key = list_slice(b.key, 1, x.d) GROUP BY a.d, a.key)
SELECT g.conv_id, g.d AS depth, p.conv_id AS parent_conv_id, g.n AS n_convs, k.children AS n_children, u.leaves AS n_leaves,
    CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(g.ended, '')) AS ends_sha256
FROM g JOIN k USING (d, key) JOIN u USING (d, key) LEFT JOIN g p ON p.d = g.d - 1 AND p.key = g.up"""


@query(sql=_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations"))
