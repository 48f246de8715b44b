"""The project view on disk: sorted shelves, their key ranges, and a substring index.

A shelf is one range of project ids in a folder of its own. The table of
shelves knows each one's first and last id and its rows, so one project, or a
page of any listing, is read from the shelves that hold it. The index lists,
for every three characters in a row of the searched fields and every piece of
a shelf, the places of the rows that have them; a search intersects the lists
of its own characters piece by piece and reads the rows that are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.plans.views import PAGE, SEARCHED, project_detail, search
from worklens.session import materialize, scratch, shuffles_freed

GRAM = 3
#: Rows and bytes of text that are taken apart at once, and rows of a task of the index.
PIECE = 10_000
PIECE_BYTES = 4_000_000
TASK_ROWS = 200_000
_PLACE_BITS = 33  # of monotonically_increasing_id


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, sizes and times of all files under the paths: another one when any input changes."""
    parts = []
    for path in paths:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        listing = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
        while listing.hasNext():
            status = listing.next()
            parts.append(f"{status.getPath()}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(parts)).encode()).hexdigest()


@dataclass(frozen=True)
class StoredView:
    rows: DataFrame  # the view's columns, shelf, place
    shelves: DataFrame  # shelf, first, last, rows
    index: DataFrame  # gram, shelf, piece, places

    @property
    def view(self) -> DataFrame:
        """The project view as it was stored."""
        return self.rows.drop("shelf", "place")

    def detail(self, project_id: str) -> DataFrame:
        """One project, read from the one shelf that can hold it."""
        found = self.shelves.where((F.col("first") <= project_id) & (F.col("last") >= project_id)).select("shelf").collect()
        shelf = [r["shelf"] for r in found]  # ranges do not overlap: at most one
        return project_detail(self.rows.where(F.col("shelf").isin(shelf)).drop("shelf", "place"), project_id)

    def candidates(self, wanted: str) -> DataFrame:
        """(shelf, place) of rows that have all three-character runs of a lower-case text."""
        runs = sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)})
        lists = self.index.where(F.col("gram").isin(runs)).groupBy("shelf", "piece").agg(F.collect_list("places").alias("lists"))
        both = F.aggregate(F.slice("lists", 2, len(runs)), F.col("lists")[0], lambda held, more: F.array_intersect(held, more))
        return lists.where(F.size("lists") == len(runs)).select("shelf", F.explode(both).alias("place"))

    def search(self, query: str = "", state: str = "all", status: str = "all", flags: str = "all") -> DataFrame:
        """As ``views.search``, with shelf and place. Queries of three characters and more read candidate rows only."""
        wanted = query.strip().lower()
        rows = self.rows
        if len(wanted) >= GRAM:
            rows = rows.join(self.candidates(wanted), ["shelf", "place"], "left_semi")
        return search(rows, query, state, status, flags)

    def page(self, found: DataFrame, number: int = 0, size: int = PAGE) -> tuple[DataFrame, int]:
        """The ``number``-th page (from 0) of a search result by project id, and the total.

        One pass counts the result by shelf; the page is then sorted from the
        shelves that hold it.
        """
        counts = {r["shelf"]: r["n"] for r in found.groupBy("shelf").agg(F.count(F.lit(1)).alias("n")).collect()}
        skip, before, needed = number * size, 0, []
        for shelf in sorted(counts):
            if before < skip + size and before + counts[shelf] > skip:
                needed.append((shelf, before))
            before += counts[shelf]
        first = needed[0][1] if needed else 0
        rows = found.where(F.col("shelf").isin([s for s, _ in needed])).orderBy("project_id")
        return rows.offset(skip - first if needed else 0).limit(size).drop("shelf", "place"), before

    def following(self, found: DataFrame, last: str | None = None, size: int = PAGE) -> DataFrame:
        """The next page after the project ``last``: no count, no shelf before it."""
        if last is not None:
            shelves = self.shelves.where(F.col("last") > last).select("shelf").collect()
            found = found.where(F.col("shelf").isin([r["shelf"] for r in shelves]) & (F.col("project_id") > last))
        return found.orderBy("project_id").limit(size).drop("shelf", "place")


def load_view(spark: SparkSession, path: str) -> StoredView:
    return StoredView(*[spark.read.parquet(f"{path}/{name}") for name in ("rows", "shelves", "index")])


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether ``store_view`` has finished under this path: the index is written last."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/index/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def _piece_lists() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of its own, so that workers need not import this package."""
    run, most = GRAM, PIECE_BYTES

    def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all texts in a row, and their number in each text."""
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = bytes(memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]])
        upto = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        return np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32), np.diff(upto[ends - ends[0]])

    def lists(places: np.ndarray, fields: list[pa.Array]) -> Iterator[tuple[int, pa.Array]]:
        """First place and (gram, places) of a stretch of rows."""
        n = len(places)
        points, lengths = zip(*map(characters, fields), strict=True)
        points, owner = np.concatenate(points), np.repeat(np.arange(len(fields) * n), np.concatenate(lengths))
        if len(points) < run:
            return
        held = np.zeros(int(points.max()) + 1, bool)
        held[points] = True
        alphabet, size = np.flatnonzero(held), int(held.sum())
        if size**run * n >= 2**63:
            for half in (slice(0, n // 2), slice(n // 2, n)):
                yield from lists(places[half], [f[half] for f in fields])
            return
        at = np.flatnonzero(owner[run - 1 :] == owner[: 1 - run])
        code = (np.cumsum(held) - 1)[points]
        key = np.zeros(len(at), np.int64)
        for i in range(run):
            key = key * size + code[at + i]
        key = key * n + owner[at] % n
        key.sort()
        gram, row = np.divmod(key[np.diff(key, prepend=-1) > 0], n)
        starts = np.flatnonzero(np.diff(gram, prepend=-1))
        if not len(starts):
            return
        letters = np.stack([alphabet[gram[starts] // size**i % size] for i in reversed(range(run))], axis=1)
        text = letters.astype("<u4").tobytes().decode("utf-32-le")
        names = pa.array([text[i : i + run] for i in range(0, len(text), run)])
        values = pa.ListArray.from_arrays(pa.array([*starts, len(row)], pa.int32()), pa.array(places[row], pa.int32()))
        yield int(places[0]), pa.StructArray.from_arrays([names, values], ["gram", "places"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shelf, piece, place = (batch.column(k).to_numpy() for k in range(3))
            fields = batch.columns[3:]
            long = np.cumsum(sum(np.diff(np.frombuffer(f.cast(pa.large_string()).buffers()[1], np.int64)[f.offset : f.offset + len(f) + 1]) for f in fields))
            edge = np.flatnonzero((np.diff(shelf) != 0) | (np.diff(piece) != 0) | (np.diff(long // most) != 0)) + 1
            for low, high in zip([0, *edge], [*edge, len(shelf)], strict=True):
                for first, found in lists(place[low:high], [f[low:high] for f in fields]):
                    held = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found)
                    yield pa.RecordBatch.from_arrays([pa.array([shelf[low]], pa.int32()), pa.array([first], pa.int32()), held], ["shelf", "piece", "lists"])

    return made


def _gram_lists(rows: DataFrame, tasks: int) -> DataFrame:
    """(gram, shelf, piece, places), sorted by gram inside every task.

    The searched fields of a piece of a shelf go to one task and are taken apart
    there: the grams, many times as long as the fields, are never shuffled, and
    leave the worker as lists of places. A piece is named by its first place;
    its lists are as long as the piece at most.
    """
    fields = [F.lower(F.coalesce(c, F.lit(""))).alias(f"f{i}") for i, c in enumerate(SEARCHED)]
    piece = F.floor(F.col("place") / PIECE).cast("int").alias("piece")
    held = rows.select(F.col("shelf").cast("int").alias("shelf"), piece, "place", *fields).repartition(max(1, tasks), "shelf", "piece")
    lists = held.sortWithinPartitions("shelf", "place").mapInArrow(
        _piece_lists(), "shelf int, piece int, lists array<struct<gram: string, places: array<int>>>"
    )
    return lists.select("shelf", "piece", F.inline("lists")).select("gram", "shelf", "piece", "places").sortWithinPartitions("gram", "shelf", "piece")


def store_view(view: DataFrame, path: str, shelves: int | None = None) -> StoredView:
    """Write a project view, its shelves and its index; what was there is replaced.

    ``shelves`` is the number of ranges, by default as many as Spark finds fit.
    """
    spark = view.sparkSession
    with scratch(), shuffles_freed(spark):
        # Written first: dealing by range reads it twice, and the first time only for its ids.
        view = materialize(view, "project-view")
        ranged = view.repartitionByRange("project_id") if shelves is None else view.repartitionByRange(shelves, "project_id")
        placed = (
            ranged.withColumn("shelf", F.spark_partition_id())
            .sortWithinPartitions("shelf", "project_id")
            .withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << _PLACE_BITS) - 1).cast("int"))
        )
        placed.write.mode("overwrite").option("compression", "zstd").partitionBy("shelf").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    found = rows.groupBy("shelf").agg(F.min("project_id").alias("first"), F.max("project_id").alias("last"), F.count(F.lit(1)).alias("rows"))
    found.coalesce(1).write.mode("overwrite").parquet(f"{path}/shelves")
    found = spark.read.parquet(f"{path}/shelves")
    held = found.agg(F.count(F.lit(1)).alias("shelves"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    with shuffles_freed(spark):
        lists = _gram_lists(rows, max(held["shelves"], held["rows"] // TASK_ROWS))
        lists.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/index")
    return load_view(spark, path)
