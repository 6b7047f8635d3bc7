"""Integer vectors in ordered segments, and exact searches of query blocks over them.

A segment is one row that holds a stretch of up to ``ROWS`` ordered vectors as matrices; a query block is the same for up to ``BLOCK``
queries. Which block has to meet which segment is decided on narrow rows by a bound. A task then holds one segment and lets
the blocks sent to it stream by, so memory is one segment and one block however many of either there are. Each task returns at most
the best k of a query; those are ranked together at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regfeed.llm.common import stored
from regfeed.session import broadcast_if_small

# Vectors of a segment and queries of a block.
ROWS, BLOCK = 4_096, 256
# Vectors of a segment that are looked at before thresholds are raised.
CHUNK = 512
# Blocks that one task compares with its segment; more are dealt to further copies of the segment.
BLOCKS_A_TASK = 64
NOTHING = np.iinfo(np.int64).min

PACKED = "part long, size int, n int, kind string, ids binary, ints binary"


def whole_vectors(vectors: DataFrame, scale: int, *others: Column) -> DataFrame:
    """``vec_id, <others>, size, ints, norm``: components as floor(scale * x), one row for each vec_id.

    A vector that is NULL or has NULL or non-finite components, and a row without vec_id, is left out. Rows of one vec_id
    count as one: the least of them by ``others`` and components. Components saturate at the square root of 2^60 / size,
    where a sum of squares would leave 64 bits (2^27 for 64 components).
    """
    vector = F.col("embedding").cast("array<double>")
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *others, vector.alias("_v")).where("vec_id is not null")
    sound = named.where(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    most = F.floor(F.sqrt(F.lit(2.0**60) / F.greatest(F.size("_v"), F.lit(1))))
    ints = F.transform("_v", lambda x: F.least(F.greatest(F.floor(x * scale), -most), most))
    names = [c for c in sound.columns if c != "_v"]
    rows = sound.select(*names, ints.alias("ints"))
    # Only ids move to find those that repeat; vectors are reduced for those alone.
    again = broadcast_if_small(stored(rows.groupBy("vec_id").agg(F.count("*").alias("_n")).where("_n > 1").select("vec_id"), "repeated"))
    rest = [c for c in rows.columns if c != "vec_id"]
    least = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct(*rest)).alias("_r"))
    single = rows.join(again, "vec_id", "left_anti").unionByName(least.select("vec_id", "_r.*"))
    squares = F.aggregate("ints", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return single.select(*names, F.size("ints").alias("size"), "ints", F.sqrt(squares).alias("norm"))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """List column without NULL, all of one length, as an int64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(rows, -1)


def narrow(ints: np.ndarray) -> np.ndarray:
    """The same values in the narrowest type that holds them."""
    top = max(int(ints.max(initial=0)), -int(ints.min(initial=0)))
    return ints.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integer matrices, exactly, in floating point where every sum fits its mantissa."""
    top = [max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in (a, b)]
    most = max(a.shape[1], 1) * top[0] * top[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


class Block:
    """What a packed row holds."""

    def __init__(self, row: dict):
        self.row, self.n, self.size = row, row["n"], row["size"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.ints = np.frombuffer(row["ints"], row["kind"]).reshape(self.n, self.size)
        self.norms = np.sqrt((self.ints.astype(np.float64) ** 2).sum(1))

    def floats(self, name: str, kind=np.float64) -> np.ndarray:
        return np.frombuffer(self.row[name], kind)


# Arrow types of the columns of packed rows.
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


def packed(rows: DataFrame, same: list[str], most: int, more: str = "", extra: Callable[[pa.Table, np.ndarray], dict] | None = None) -> DataFrame:
    """Rows of sorted partitions (``vec_id, size, ints`` and more) packed into one row for up to ``most`` that agree in ``same``.

    ``extra`` gives the values of the columns declared in ``more`` from the rows and their matrix. ``part`` follows the order of rows.
    """
    schema = PACKED + (", " + more if more else "")
    arrow = pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: pa.Table | None = None

        def pack(table: pa.Table) -> pa.RecordBatch:
            nonlocal number
            lists = table.column("ints").combine_chunks()
            ints = matrix(lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists, table.num_rows)
            small = narrow(ints)
            row = {
                "part": number,
                "size": ints.shape[1],
                "n": table.num_rows,
                "kind": small.dtype.str,
                "ids": table.column("vec_id").to_numpy().astype(np.int64).tobytes(),
                "ints": small.tobytes(),
            } | (extra(table, ints) if extra else {})
            number += 1
            return pa.RecordBatch.from_pydict({c: [row[c]] for c in arrow.names}, schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            change = np.zeros(held.num_rows, bool)
            for name in same:
                values = held.column(name).to_numpy()
                change[1:] |= values[1:] != values[:-1]
            change[0] = True
            starts = np.flatnonzero(change).tolist()
            for a, b in zip(starts, [*starts[1:], None], strict=True):
                # The last stretch may go on in the next batch, so its end is kept back.
                end = held.num_rows if b is None else b
                while end - a > most:
                    yield pack(held.slice(a, most))
                    a += most
                if b is not None:
                    yield pack(held.slice(a, end - a))
                else:
                    held = held.slice(a)
        if held is not None:
            yield pack(held)

    return rows.mapInArrow(run, schema)


class Best:
    """The best ``k`` (score, id) of each member so far: higher scores first, then smaller ids.

    ``least`` is the score a member's next hit must reach, with an id below ``least_id`` if it has that very score. They start
    with what the caller knows and only get stricter, so equal rows beyond the first k are not kept.
    """

    def __init__(self, k: int, least: np.ndarray, least_id: np.ndarray | None = None):
        self.k, self.least = k, least.astype(np.int64, copy=True)
        self.least_id = np.full(len(least), np.iinfo(np.int64).max) if least_id is None else least_id.astype(np.int64, copy=True)
        self.member, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, member: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        least = self.least[member]
        better = (score > least) | ((score == least) & (ids < self.least_id[member]))
        member, score, ids = member[better], score[better], ids[better]
        if len(member):
            self.waiting.append((member.astype(np.int64), score, ids))

    def settle(self) -> None:
        if not self.waiting:
            return
        member, score, ids = (np.concatenate([old, *new]) for old, new in zip((self.member, self.score, self.id), zip(*self.waiting, strict=True), strict=True))
        self.waiting = []
        order = np.lexsort((ids, -score, member))
        member, score, ids = member[order], score[order], ids[order]
        rank = np.arange(len(member)) - np.searchsorted(member, member)
        last = rank == self.k - 1
        # Only better hits than those known come in, so the k-th of them is stricter than what was known before.
        self.least[member[last]], self.least_id[member[last]] = score[last], ids[last]
        keep = rank < self.k
        self.member, self.score, self.id = member[keep], score[keep], ids[keep]


def met(blocks: DataFrame, pairs: DataFrame, segments: DataFrame, search: Callable[[], Callable[[Block, dict], Iterator[pa.RecordBatch]]], schema: str, order: list[str]) -> DataFrame:
    """Run ``search`` for each pair (``block, segment``) of packed rows, a segment at a time.

    ``search()`` is made once for a task; it is called with a segment and the row of a block, blocks in the given order.
    """
    spark = segments.sparkSession
    # A packed row can take megabytes: a batch is a few of them.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    dealt = pairs.withColumn("shard", F.pmod(F.xxhash64("block"), F.greatest(F.ceil(F.count("*").over(Window.partitionBy("segment")) / BLOCKS_A_TASK), F.lit(1))))
    dealt = stored(dealt.select("block", "segment", "shard"), "pairs")
    wanted = dealt.select("segment", "shard").distinct()
    many = wanted.count()
    held = segments.join(broadcast_if_small(wanted), segments["part"] == wanted["segment"]).drop("part").withColumn("side", F.lit(0))
    sent = blocks.join(broadcast_if_small(dealt), blocks["part"] == dealt["block"]).drop("part").withColumn("side", F.lit(1))
    # Twice as many partitions as segments in use, so that few of them share one.
    both = held.unionByName(sent, allowMissingColumns=True).repartition(max(1, min(2 * many, 20_000)), "segment", "shard")
    both = both.sortWithinPartitions("segment", "shard", "side", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare, segment = search(), None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["side"] == 0:
                    segment = Block(row)
                else:
                    yield from compare(segment, row)

    return both.mapInArrow(run, schema)


def ranked(rows: DataFrame, keys: list[str], k: int, score: str, tie: str) -> DataFrame:
    """``rank`` from 1 inside ``keys``, the first ``k``; what is beyond is dropped before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bounded_sample(rows: DataFrame, values: int) -> list:
    """Rows with the least hash of their id, as many as hold about ``values`` components; for fits that decide effort only."""
    widest = rows.agg(F.max("size")).first()[0] or 1
    hashed = rows.select("vec_id", "size", "ints").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, values // max(widest, 1)))
    return hashed.collect()
