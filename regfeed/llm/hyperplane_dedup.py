"""Near copies among embeddings: sign hashes of random hyperplanes in several tables, exact cosines, components.

Vectors with the same label and equal components are one class from the start. A class has one bucket in each table, named
by the signs of its products with that table's hyperplanes. Buckets with one class only are dropped before any vector is
moved. The others are compared as matrices inside tasks: many small buckets share a task, and a large one is cut into blocks
of which each pair is a task. A pair that meets in several tables counts in the first of them, which both sides'
bucket names tell. Tasks return counts and spanning trees, never pairs.

A pair with cosine c is missed with probability (1 - p^bits)^tables, p = 1 - arccos(c) / pi. With 12 bits and 48 tables that
is under 1 in 100,000 at c = 0.93 and less above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfeed.llm.common import stored
from regfeed.llm.components import Forest, components

BITS, TABLES, SEED = 12, 48, 20_240_101
# Classes of a block; a task holds two.
BLOCK = 1_024
# Rows of small buckets that share a task.
CELL_ROWS = 20_000
PAIRS_AT_ONCE = 100_000


def hyperplanes(size: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, tables * bits))


def _codes(bits: int, tables: int, seed: int):
    """Each class with its components as bytes and its bucket in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = [np.array(v, np.float64) for v in batch.column("vector").to_pylist()]
            codes: list = [None] * len(vectors)
            for size in {len(v) for v in vectors}:
                rows = [k for k, v in enumerate(vectors) if len(v) == size]
                if size not in planes:
                    planes[size] = hyperplanes(size, bits, tables, seed)
                side = (np.stack([vectors[k] for k in rows]) @ planes[size] >= 0).reshape(len(rows), tables, bits)
                for k, code in zip(rows, (side << np.arange(bits)).sum(2).astype(np.int32), strict=True):
                    codes[k] = code
            kept = [batch.column(c) for c in ("rep", "label", "copies")]
            data = [pa.array([x.tobytes() for x in xs], pa.binary()) for xs in (vectors, codes)]
            buckets = pa.array([c.tolist() for c in codes], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept, *data, buckets], ["rep", "label", "copies", "vector", "codes", "buckets"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    cosine = (x @ y.T) / np.outer(np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1)))
    return np.nonzero(cosine >= least)


def _compare(least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
        links, forest = np.zeros(len(rows), np.int64), Forest(len(rows))
        sizes = rows["vector"].str.len().to_numpy()
        block = rows["block"].to_numpy()
        key = rows.groupby(["label", "tab", "bucket", "low", "high", sizes], sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(key, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(order)]])
        vectors, codes, table = rows["vector"].to_numpy(), rows["codes"].to_numpy(), rows["tab"].to_numpy()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            at = order[a:b]
            x = np.frombuffer(b"".join(vectors[at]), np.float64).reshape(len(at), -1)
            own = block[at]
            if own.min() == own.max():
                left, right = _linked(x, x, least)
                left, right = left[left < right], right[left < right]
            else:
                one, two = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
                left, right = _linked(x[one], x[two], least)
                left, right = one[left], two[right]
            if not len(left):
                continue
            names = np.frombuffer(b"".join(codes[at]), np.int32).reshape(len(at), -1)[:, : table[at[0]]]
            for k in range(0, len(left), PAIRS_AT_ONCE):
                l, r = left[k : k + PAIRS_AT_ONCE], right[k : k + PAIRS_AT_ONCE]
                new = ~(names[l] == names[r]).any(1)
                l, r = at[l[new]], at[r[new]]
                np.add.at(links, l, copies[r])
                np.add.at(links, r, copies[l])
                for i, j in zip(l.tolist(), r.tolist(), strict=True):
                    forest.union(i, j)
        root = ids[[forest.find(k) for k in range(len(ids))]]
        out = pd.DataFrame({"rep": ids, "links": links, "root": root})
        return out[(out["links"] > 0) | (out["rep"] != out["root"])]

    return run


def near_copies(
    vectors: DataFrame, least: float = 0.93, bits: int = BITS, tables: int = TABLES, seed: int = SEED
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row for each row of ``vectors`` (``vec_id, embedding, label``).

    Vectors are linked when their labels are equal and not NULL, their lengths are equal and their cosine, in double
    precision, is ``least`` or more. A vector that is NULL, empty, zero, or has NULL or non-finite components is linked with
    nothing, and so is one with a NULL label. ``component_id`` is the smallest vec_id reachable; ``kept`` tells whether it
    is the row's own. Rows of one vec_id count as one; a NULL vec_id has NULL component and is kept. Other columns are ignored.
    """
    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector")
    )
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    # The square of a component can overflow or vanish in double precision; float vectors are far from that.
    usable = F.coalesce(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    given = given.withColumn("hash", F.when(usable, F.xxhash64("vector")))
    classes = given.where("hash is not null").groupBy("label", "hash", "vector").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies"))
    coded = stored(
        classes.select("rep", "label", "copies", "vector").mapInArrow(
            _codes(bits, tables, seed), "rep long, label string, copies long, vector binary, codes binary, buckets array<int>"
        ),
        "codes",
    )
    entries = coded.select("rep", "label", F.posexplode("buckets").alias("tab", "bucket"))
    sizes = entries.groupBy("label", "tab", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = entries.join(sizes, ["label", "tab", "bucket"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    met = stored(
        met.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("rep", "tab"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("rep", "tab", "bucket", "block", "blocks", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")),
        "buckets",
    )
    cells = max(1, -(-met.count() // CELL_ROWS))
    small = F.pmod(F.xxhash64("label", "tab", "bucket"), F.lit(cells))
    rows = met.join(coded.drop("buckets"), "rep").withColumn(
        "cell", F.when(F.col("blocks") == 1, small).otherwise(F.xxhash64("label", "tab", "bucket", "low", "high"))
    )
    found = stored(rows.drop("blocks").groupBy("cell").applyInPandas(_compare(least), "rep long, links long, root long"), "links")
    direct = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found, "rep", "root").select(F.col("id").alias("rep"), "component")
    known = classes.join(direct, "rep", "left").join(joined, "rep", "left")
    known = known.select("label", "hash", "vector", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = given.join(known, ["label", "hash", "vector"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
