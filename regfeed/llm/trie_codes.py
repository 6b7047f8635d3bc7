"""Vector codes by product quantisation; nearest entries are found on a trie of the distinct parts.

Each vector is cut into equal parts, and every part gets the number of its nearest codebook entry. Equal parts are reduced to one row with
a weight, sorted, and stored once, so that a task reads a stretch of the lexicographic order: a piece of the trie. It is walked depth
first. A node holds, for all entries at once, the squared distance over the dimensions of its prefix; a child adds one dimension, so parts
with a common prefix share it. A subtree of few leaves is finished level by level in one array. Leaves take the argmin, and
add their components, times their weight, to the entry's sum. Only sums of entries leave the tasks: the codebooks have a fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfeed.llm.common import stored
from regfeed.llm.vector_lists import matrix, whole_vectors
from regfeed.session import broadcast_if_small

PARTS, ENTRIES, ROUNDS = 4, 256, 4
# Leaves of a subtree that are finished in one array.
LEAVES = 512
# Distinct parts of a task, unless there are too few to give every core some.
TASK_PARTS = 200_000


def narrowest(parts: np.ndarray, entries: np.ndarray) -> type:
    """Integers in which no squared distance can overflow. ``whole_vectors`` keeps all of them within 64 bits."""
    top = max(int(np.abs(m).max(initial=0)) for m in (parts, entries))
    return np.int32 if parts.shape[1] * (2 * top) ** 2 < 1 << 31 else np.int64


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``parts``, sorted and distinct: the nearest entry (ties to the lower index) and its squared distance."""
    n, depth = parts.shape
    code, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    kind = narrowest(parts, entries)
    parts, by_dimension = parts.astype(kind), np.ascontiguousarray(entries.astype(kind).T)
    # Where a row first differs from the one above it.
    fresh = np.zeros(n, np.int64)
    if n > 1 and depth:
        fresh[1:] = (parts[1:] != parts[:-1]).argmax(1)
    stack = [(0, n, 0, np.zeros(len(entries), kind))] if n else []
    while stack:
        low, high, level, so_far = stack.pop()
        if high - low <= LEAVES or level == depth:
            code[low:high], distance[low:high] = _finish(parts[low:high], fresh[low:high], by_dimension, level, so_far)
            continue
        # Children of this node: runs of equal values at its dimension.
        starts = low + np.flatnonzero(np.append(True, fresh[low + 1 : high] <= level))
        ends = np.append(starts[1:], high)
        if len(starts) > 1 and (ends - starts).max() * 2 <= LEAVES:
            # Many small children: joined up to arrays of a size worth one step each.
            group = (starts - low) // LEAVES
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            for a, b in zip(starts[first].tolist(), np.append(starts[first][1:], high).tolist(), strict=True):
                code[a:b], distance[a:b] = _finish(parts[a:b], fresh[a:b], by_dimension, level, so_far)
            continue
        # Last child first on the stack, so that the order of leaves is kept.
        for a, b in zip(starts[::-1].tolist(), ends[::-1].tolist(), strict=True):
            stack.append((a, b, level + 1, so_far + (parts[a, level] - by_dimension[level]) ** 2))
    return code, distance


def _finish(parts: np.ndarray, fresh: np.ndarray, by_dimension: np.ndarray, level: int, so_far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of a small subtree: each level has one row for each different prefix, made from its parent's."""
    rows, node = so_far[None, :], np.zeros(len(parts), np.int64)
    for k in range(level, parts.shape[1]):
        starts = fresh <= k
        starts[0] = True
        first = np.flatnonzero(starts)
        step = parts[first, k][:, None] - by_dimension[k]
        step *= step
        # A level without forks goes on in place.
        rows = rows + step if len(first) == len(rows) else rows[node[first]] + step
        node = np.cumsum(starts) - 1
    code = rows.argmin(1)
    return code[node], rows[np.arange(len(rows)), code][node].astype(np.int64)


def _weighted(books: dict[int, np.ndarray]):
    """Weight and weighted sum of components of each entry, from distinct parts in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch.column("part").to_numpy()
            weight = batch.column("weight").to_numpy()
            for p in np.unique(position).tolist():
                at = np.flatnonzero(position == p)
                parts = matrix(batch.column("ints").take(pa.array(at)), len(at))
                code, _ = nearest(parts, books[p])
                used, entry = np.unique(code, return_inverse=True)
                # Python's own integers where a sum may leave 64 bits.
                kind = object if _large(parts, weight[at]) else np.int64
                sums = np.zeros((len(used), parts.shape[1]), kind)
                np.add.at(sums, entry, parts.astype(kind) * weight[at].astype(kind)[:, None])
                count = np.zeros(len(used), np.int64)
                np.add.at(count, entry, weight[at])
                m, d = sums.shape
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(np.full(m * d, p, np.int32)),
                        "entry": pa.array(np.repeat(used, d).astype(np.int32)),
                        "place": pa.array(np.tile(np.arange(d, dtype=np.int32), m)),
                        "total": pa.array([str(v) for v in sums.ravel().tolist()], pa.string()),
                        "weight": pa.array(np.repeat(count, d)),
                    }
                )

    return run


def _large(parts: np.ndarray, weight: np.ndarray) -> bool:
    return int(np.abs(parts).max(initial=0)) * int(weight.sum()) >= 1 << 62


def _coded(books: dict[int, np.ndarray], depth: int):
    """Code and error of whole vectors: the parts of a step are made distinct and walked as a trie of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            ints = matrix(batch.column("ints"), n)
            codes, error = np.zeros((n, len(books)), np.uint8), np.zeros(n, np.int64)
            for p, entries in books.items():
                parts, row = np.unique(ints[:, p * depth : (p + 1) * depth], axis=0, return_inverse=True)
                code, distance = nearest(parts, entries)
                codes[:, p], error = code[row.ravel()], error + distance[row.ravel()]
            text = [c.tobytes().hex() for c in codes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"]
            )

    return run


def updated(entries: np.ndarray, sums: dict[int, list[int]], weights: dict[int, int]) -> np.ndarray:
    """Entries that were used become the floor of their mean; the others stay."""
    out = entries.copy()
    for entry, total in sums.items():
        out[entry] = [v // weights[entry] for v in total]
    return out


def digest(books: dict[int, np.ndarray]) -> str:
    text = ",".join(str(v) for p in sorted(books) for v in books[p].ravel().tolist())
    return hashlib.sha256(text.encode()).hexdigest()


def compress(vectors: DataFrame, scale: int = 1_024, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``vec_id, code, error, label_error`` of each vector, and the codebook of each part position.

    ``vectors`` has ``vec_id, embedding, label``; other columns are ignored. Components are floor(scale * x). Codebooks begin as the parts of the
    256 smallest vec_ids (fewer, if there are fewer) and are refined ``rounds`` times over all rows. ``error`` is the squared distance of
    a vector to its entries, ``label_error`` its sum over rows of the same label, NULL labels together.

    Rows without vec_id and vectors that are NULL or have NULL or non-finite components are left out. Rows of one vec_id count as one, the least by
    label and components. Vectors that are not as long as most others (ties: the longer) get NULL as code and error and do not count in label_error; of
    a length that is no multiple of 4 the last part is filled up with zeros. An empty table gives no rows and empty codebooks.
    """
    rows = stored(whole_vectors(vectors, scale, F.col("label")), "vectors")
    commonest = rows.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("size").desc()).first()
    size = commonest["size"] if commonest else 0
    depth = -(-size // PARTS)
    filled = F.concat("ints", F.array_repeat(F.lit(0).cast("long"), PARTS * depth - size)) if PARTS * depth > size else F.col("ints")
    fit = rows.where(F.col("size") == size).select("vec_id", "label", filled.alias("ints"))
    first = fit.orderBy("vec_id").limit(ENTRIES).select("ints").collect()
    start = np.array([r["ints"] for r in first], np.int64).reshape(len(first), PARTS * depth)
    books = {p: start[:, p * depth : (p + 1) * depth] for p in range(PARTS)}

    cut = F.array(*[F.struct(F.lit(p).alias("part"), F.slice("ints", p * depth + 1, depth).alias("ints")) for p in range(PARTS)])
    distinct = fit.select(F.inline(cut)).groupBy("part", "ints").agg(F.count("*").alias("weight"))
    # In lexicographic order, so that a task gets whole branches.
    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-PARTS * (commonest["n"] if commonest else 0) // TASK_PARTS))
    trie = stored(distinct.repartitionByRange(tasks, "part", "ints").sortWithinPartitions("part", "ints"), "trie")
    for _ in range(rounds if first and depth else 0):
        used = trie.mapInArrow(_weighted(books), "part int, entry int, place int, total string, weight long")
        sums = used.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("weight").alias("weight"))
        # One row for each component of the codebooks, whatever the number of vectors.
        found = sums.groupBy("part", "entry").agg(F.sort_array(F.collect_list(F.struct("place", "total"))).alias("totals"), F.max("weight").alias("weight")).collect()
        totals: dict[int, dict] = {p: {} for p in books}
        weights: dict[int, dict] = {p: {} for p in books}
        for r in found:
            totals[r["part"]][r["entry"]] = [int(t["total"]) for t in r["totals"]]
            weights[r["part"]][r["entry"]] = int(r["weight"])
        books = {p: updated(books[p], totals[p], weights[p]) for p in books}

    kind = rows.schema["label"].dataType.simpleString()
    coded = stored(fit.mapInArrow(_coded(books, depth), f"vec_id long, label {kind}, code string, error long"), "codes")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    by_label = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    by_label = broadcast_if_small(stored(by_label, "label-errors")).withColumnRenamed("label", "_label")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left").select("vec_id", "code", "error", "label_error")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"))]
    return joined.unionByName(rows.where(F.col("size") != size).select("vec_id", *nothing)), books
