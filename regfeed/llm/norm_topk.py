"""Exact top-k inner products over vectors in descending length.

Vectors are range-sorted by length into segments. The longest ones give every query a first threshold. After that a query block goes only to
segments whose greatest length, times the query's, can still reach the threshold; inside a segment it stops at the first chunk that
cannot (Cauchy-Schwarz). What remains is compared by partial sums: vectors are rotated by the right singular vectors of a bounded
sample, a quarter of the rotated components is multiplied out, and the rest is bounded by the product of the residual lengths.
Only pairs whose bound reaches the threshold are multiplied exactly, in integers. The sample decides effort, never results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfeed.llm.common import stored
from regfeed.llm.vector_lists import BLOCK, CHUNK, NOTHING, ROWS, Best, Block, bounded_sample, exact, met, packed, ranked, whole_vectors
from regfeed.session import broadcast_if_small

# Components of all sampled vectors together.
SAMPLE_VALUES = 1 << 18
# One of so many rotated components is multiplied out before the bound is looked at.
HEAD_PART = 4
# Allowance for rounding, relative to the product of both lengths.
SLACK = 1e-5
# Above this share of open pairs one matrix product is cheaper than single ones.
DENSE = 0.1


def rotations(sample: list) -> dict[int, np.ndarray]:
    """For each vector size the leading right singular vectors of the sampled vectors, as columns."""
    by_size: dict[int, list] = {}
    for row in sample:
        by_size.setdefault(row["size"], []).append(row["ints"])
    found = {}
    for size, rows in by_size.items():
        if size:
            _, _, right = np.linalg.svd(np.array(rows, np.float64), full_matrices=False)
            found[size] = np.ascontiguousarray(right[: max(1, size // HEAD_PART)].T)
    return found


def turned(ints: np.ndarray, norms: np.ndarray, rotation: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated components, and the length of all others."""
    if rotation is None:
        rotation = np.eye(ints.shape[1])[:, : max(1, ints.shape[1] // HEAD_PART)]
    head = ints.astype(np.float64) @ rotation
    return head, np.sqrt(np.maximum(norms**2 - (head**2).sum(1), 0.0))


def search_segment(x: Block, head: np.ndarray, tail: np.ndarray, q: Block, q_head: np.ndarray, q_tail: np.ndarray, best: Best) -> None:
    """Put what ``x`` (by descending length) holds of the best of each query of ``q`` into ``best``."""
    for a in range(0, x.n, CHUNK):
        b = min(a + CHUNK, x.n)
        # Lengths only fall from here on.
        open_ = np.flatnonzero(q.norms * x.norms[a] * (1 + SLACK) >= best.least)
        if not len(open_):
            return
        bound = q_head[open_] @ head[a:b].T
        bound += np.outer(q_tail[open_], tail[a:b])
        bound += SLACK * np.outer(q.norms[open_], x.norms[a:b])
        i, j = np.nonzero(bound >= best.least[open_][:, None])
        if not len(i):
            continue
        if len(i) > DENSE * bound.size:
            score = exact(q.ints[open_], x.ints[a:b])[i, j]
        else:
            score = np.concatenate(
                [(q.ints[open_[i[s : s + 65_536]]].astype(np.int64) * x.ints[a + j[s : s + 65_536]]).sum(1) for s in range(0, len(i), 65_536)]
            )
        member, ids = open_[i], x.ids[a + j]
        keep = ids != q.ids[member]
        best.add(member[keep], score[keep], ids[keep])
        best.settle()


def _search(fitted: dict[int, np.ndarray], k: int):
    def make():
        held: list = [None, None, None]

        def run(segment: Block, row: dict) -> Iterator[pa.RecordBatch]:
            if held[0] is not segment:
                held[:] = segment, *turned(segment.ints, segment.norms, fitted.get(segment.size))
            q = Block(row)
            best = Best(k, q.floats("least", np.int64), q.floats("least_id", np.int64))
            search_segment(segment, held[1], held[2], q, *turned(q.ints, q.norms, fitted.get(q.size)), best)
            yield pa.RecordBatch.from_pydict({"query_id": q.ids[best.member], "vec_id": best.id, "score": best.score})

        return run

    return make


def _lengths(table: pa.Table, ints: np.ndarray) -> dict:
    return {"peak": float(np.max(table.column("norm").to_numpy(), initial=0.0))}


def _demands(table: pa.Table, ints: np.ndarray) -> dict:
    """Known thresholds, and the least length a vector must have to matter to any query of the block."""
    known = {c: table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("least", "least_id")}
    return known | {"need": float(np.min(table.column("need").to_numpy()))}


def _blocks(queries: DataFrame) -> DataFrame:
    """Queries that need vectors of like length share a block."""
    ordered = queries.repartitionByRange("size", F.col("need").desc(), "vec_id").sortWithinPartitions("size", F.col("need").desc(), "vec_id")
    return stored(packed(ordered, ["size"], BLOCK, "least binary, least_id binary, need double", _demands), "query-blocks")


def top_inner_products(vectors: DataFrame, query_every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` greatest inner products of each query with all other rows, ties to smaller ids.

    ``vectors`` has ``vec_id, embedding``; other columns are ignored. Components are floor(scale * x). Queries are the rows whose
    vec_id is divisible by ``query_every``. Vectors that are NULL or have NULL or non-finite components, and rows without vec_id, take no part. Vectors of
    unequal lengths are not compared. Rows of one vec_id count as one (the least vector); equal vectors under several ids are
    several candidates. A query with fewer candidates gets them all, an empty table gives none. Empty vectors score 0.
    """
    rows = stored(whole_vectors(vectors, scale), "vectors")
    fitted = rotations(bounded_sample(rows, SAMPLE_VALUES))
    by_length = ["size", F.col("norm").desc(), "vec_id"]
    ordered = rows.repartitionByRange(*by_length).sortWithinPartitions(*by_length)
    segments = stored(packed(ordered, ["size"], ROWS, "peak double", _lengths), "segments")
    summary = stored(segments.select(F.col("part").alias("segment"), F.col("size").alias("_size"), "peak", "n"), "lengths")
    first = summary.groupBy("_size").agg(F.max_by("segment", F.struct("peak", "n", "segment")).alias("segment"))

    schema = "query_id long, vec_id long, score long"
    queries = rows.where(F.col("vec_id") % query_every == 0)
    nothing = {"least": F.lit(int(NOTHING)), "least_id": F.lit((1 << 63) - 1)}
    unknown = queries.withColumns(nothing | {"need": F.lit(0.0)})
    blocks = _blocks(unknown)
    pairs = blocks.select(F.col("part").alias("block"), "size").join(broadcast_if_small(first), F.col("size") == F.col("_size"))
    lead = stored(met(blocks, pairs, segments, _search(fitted, k), schema, ["need"]), "first-hits")

    # The k-th best of the longest vectors is what any other must reach.
    reached = ranked(lead, ["query_id"], k, "score", "vec_id").where(F.col("rank") == k)
    reached = reached.select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"), F.col("vec_id").alias("least_id"))
    known = queries.join(reached, "vec_id", "left").withColumns({c: F.coalesce(c, v) for c, v in nothing.items()})
    need = F.when((F.col("least") > 0) & (F.col("norm") > 0), F.col("least") / F.col("norm") * (1 - SLACK)).otherwise(0.0)
    blocks = _blocks(known.withColumn("need", need))
    others = summary.join(broadcast_if_small(first.select("segment")), "segment", "left_anti")
    pairs = blocks.select(F.col("part").alias("block"), "size", "need").join(broadcast_if_small(others), F.col("size") == F.col("_size"))
    rest = met(blocks, pairs.where(F.col("peak") >= F.col("need")), segments, _search(fitted, k), schema, ["need"])
    return ranked(lead.unionByName(rest), ["query_id"], k, "score", "vec_id").select("query_id", "rank", "vec_id", "score")
