"""Hard negatives by lists that all anchors of a cluster share.

Anchors are clustered by direction. For a cluster with centroid c whose members lie within the angle b of it, a vector x at the angle t
from c has an inner product of at most |q| |x| cos(max(0, t - b)) with any member q. That bound without |q| orders one list of candidates
for the whole cluster; each member walks it from the top and stops when the bound, times its own length, is below what it
still needs: no later candidate can matter.

The list is kept in two levels, so that vectors are stored once and not once for each cluster: segments of one label, whose greatest bound
for each cluster orders them, and inside a segment the candidates sorted by their bound, once for all members that come there.
A member is sent only to segments that can still matter to it. Positives come first: the best segment of each list gives a threshold,
then the rest. Their scores fix what a negative must have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfeed.llm.common import stored
from regfeed.llm.vector_lists import BLOCK, CHUNK, NOTHING, Best, Block, bounded_sample, exact, matrix, met, packed, ranked, whole_vectors
from regfeed.session import broadcast_if_small

# Vectors of a segment; a list is cut there, so that it is walked by several tasks.
ROWS = 2_048
# Centroids are fitted on a sample of anchors with so many components together. They decide effort, never results.
SAMPLE_VALUES = 1 << 18
CLUSTERS, ANCHORS_A_CLUSTER, ROUNDS = 64, 32, 8
# Allowances for rounding: of an angle, and relative.
ANGLE_SLACK, SLACK = 1e-6, 1e-9
ANY = float("-inf")


def centroids(sample: list, clusters: int = CLUSTERS) -> dict[int, np.ndarray]:
    """For each vector size unit centroids of the sampled anchors, by spherical k-means."""
    by_size: dict[int, list] = {}
    for row in sample:
        by_size.setdefault(row["size"], []).append(row["ints"])
    found = {}
    for size, rows in by_size.items():
        x = np.array(rows, np.float64).reshape(len(rows), size)
        x = x[(x != 0).any(1)]
        if not len(x):
            continue
        x /= np.sqrt((x * x).sum(1))[:, None]
        centers = x[:: max(1, len(x) // max(1, min(clusters, len(x) // ANCHORS_A_CLUSTER)))][:clusters]
        for _ in range(ROUNDS):
            sums = np.zeros_like(centers)
            np.add.at(sums, (x @ centers.T).argmax(1), x)
            length = np.sqrt((sums * sums).sum(1))
            # A centroid without anchors, or with opposite ones, stays.
            moved = length > 1e-9
            centers = np.where(moved[:, None], sums / np.where(moved, length, 1)[:, None], centers)
        found[size] = centers
    return found


def cosines(ints: np.ndarray, centers: np.ndarray) -> np.ndarray:
    x = ints.astype(np.float64)
    length = np.sqrt((x * x).sum(1))
    return np.clip(x @ centers.T / np.where(length > 0, length, 1)[:, None], -1, 1)


def _placed(fitted: dict[int, np.ndarray]):
    """The nearest centroid and the cosine with it; cluster -1 holds vectors of a size that has no centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, near = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                if size in fitted:
                    at = np.flatnonzero(sizes == size)
                    cosine = cosines(matrix(batch.column("ints").take(pa.array(at)), len(at)), fitted[size])
                    cluster[at], near[at] = cosine.argmax(1), cosine.max(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(near)], [*batch.schema.names, "cluster", "near"])

    return run


class Lists:
    """Upper bounds, per length of the query, of inner products with the members of each cluster."""

    def __init__(self, fitted: dict[int, np.ndarray], spread: dict[tuple[int, int], float]):
        self.fitted, self.spread = fitted, spread

    def bounds(self, x: Block, cluster: int) -> np.ndarray:
        if (x.size, cluster) not in self.spread or x.size not in self.fitted:
            return x.norms
        angle = np.arccos(cosines(x.ints, self.fitted[x.size][cluster : cluster + 1])[:, 0])
        return x.norms * np.cos(np.maximum(angle - self.spread[x.size, cluster] - ANGLE_SLACK, 0))

    def clusters(self, size: int) -> list[int]:
        return [c for s, c in self.spread if s == size] or [-1]


def _peaks(lists: Lists):
    """The greatest bound of each segment for each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = Block(row)
                known = lists.clusters(x.size)
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": pa.array([row["part"]] * len(known), pa.int64()),
                        "size": pa.array([x.size] * len(known), pa.int32()),
                        "label": pa.array([row["label"]] * len(known), pa.int64()),
                        "cluster": pa.array(known, pa.int32()),
                        "peak": pa.array([float(lists.bounds(x, c).max()) for c in known]),
                        "n": pa.array([x.n] * len(known), pa.int32()),
                    }
                )

    return run


def walk(x: Block, order: np.ndarray, bounds: np.ndarray, q: Block, anchor: np.ndarray, highest: np.ndarray, best: Best) -> None:
    """Every member goes down the list ``order`` until its bound certifies that nothing below can matter.

    A member is row ``anchor`` of ``q`` looking for scores from ``best.least`` to ``highest``.
    """
    for a in range(0, x.n, CHUNK):
        at = order[a : a + CHUNK]
        going = np.flatnonzero(q.norms[anchor] * bounds[at[0]] * (1 + SLACK) >= best.least)
        if not len(going):
            return
        used, row = np.unique(anchor[going], return_inverse=True)
        score = exact(q.ints[used], x.ints[at])[row]
        i, j = np.nonzero((score >= best.least[going][:, None]) & (score <= highest[going][:, None]))
        member, ids = going[i], x.ids[at[j]]
        other = ids != q.ids[anchor[member]]
        best.add(member[other], score[i, j][other], ids[other])
        best.settle()


def _walks(lists: Lists, k: int, members: str):
    """Walks of the members of a block: anchors themselves, or each of their positives with its window of scores."""

    def make():
        held: dict = {"segment": None}

        def run(segment: Block, row: dict) -> Iterator[pa.RecordBatch]:
            if held["segment"] is not segment or held["cluster"] != row["cluster"]:
                # Sorted once for a cluster; its blocks follow each other.
                bounds = lists.bounds(segment, row["cluster"])
                held.update(segment=segment, cluster=row["cluster"], bounds=bounds, order=np.lexsort((segment.ids, -bounds)))
            q = Block(row)
            least = q.floats("least", np.int64)
            if members == "anchors":
                anchor, highest = np.arange(q.n), np.full(q.n, np.iinfo(np.int64).max)
                positive = np.zeros(q.n, np.int64)
            else:
                anchor, positive, highest = (q.floats(c, np.int64) for c in ("anchor", "positive", "highest"))
            best = Best(k, least)
            walk(segment, held["order"], held["bounds"], q, anchor, highest, best)
            at = best.member
            yield pa.RecordBatch.from_pydict(
                {"anchor_id": q.ids[anchor[at]], "positive_id": positive[at], "positive_score": highest[at], "vec_id": best.id, "score": best.score}
            )

        return run

    return make


HITS = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"
_MEMBERS = "label long, cluster int, least binary, need double"


def _first(table: pa.Table, column: str):
    return table.column(column)[0].as_py()


def _anchors(table: pa.Table, ints: np.ndarray) -> dict:
    return {
        "label": _first(table, "label"),
        "cluster": _first(table, "cluster"),
        "least": table.column("least").to_numpy().astype(np.int64).tobytes(),
        "need": float(np.min(table.column("need").to_numpy())),
    }


def _windows(table: pa.Table, ints: np.ndarray) -> dict:
    """A member for each positive: its least and highest score."""
    lists = [p or [] for p in table.column("positives").to_pylist()]
    flat = [(k, p["vec_id"], p["score"]) for k, ps in enumerate(lists) for p in ps]
    anchor, positive, highest = (np.array(c, np.int64) for c in (zip(*flat, strict=True) if flat else ([], [], [])))
    # 80 p <= 100 n, in whole numbers: n >= p - floor(p / 5).
    least = highest - highest // 5
    columns = {"anchor": anchor, "positive": positive, "highest": highest, "least": least}
    return _anchors(table, ints) | {c: v.tobytes() for c, v in columns.items()}


def _blocks(anchors: DataFrame, extra, more: str) -> DataFrame:
    """Anchors of one label and cluster in blocks, those with like demands together."""
    by = ["size", "label", "cluster", F.col("need").desc(), "vec_id"]
    return stored(packed(anchors.repartitionByRange(*by).sortWithinPartitions(*by), ["size", "label", "cluster"], BLOCK, more, extra), "anchor-blocks")


def _need(score, norm) -> F.Column:
    """The bound a segment must have for a member that needs ``score``; bounds may be negative, and any will do for a score of 0 or less."""
    return F.when((score > 0) & (norm > 0), score / norm * (1 - 1e-6)).otherwise(ANY)


def hard_negatives(
    vectors: DataFrame, anchor_every: int = 100, shift_every: int = 7, labels: int = 10, positives: int = 5, negatives: int = 5, scale: int = 256
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, embedding, label``; other columns are ignored. Components are floor(scale * x), scores integer inner
    products, greater ones first, ties by smaller vec_id. Where vec_id is divisible by ``shift_every``, the label is taken as
    (label + 1) % ``labels``. For each anchor (vec_id divisible by ``anchor_every``) and each of its first ``positives`` other rows of its label,
    the first ``negatives`` rows of other labels whose score is 0.8 to 1 times the positive's; a positive score below 0 has none.

    Rows with a NULL vec_id, a label that is NULL or no number, a NULL vector, or NULL or non-finite components take no part. Vectors of unequal
    lengths are not compared. Rows of one vec_id count as one, the least by label and components; equal vectors under several ids are
    several rows. An empty table, or one label only, gives no rows.
    """
    label = F.col("label").try_cast("long")
    moved = F.when(F.col("vec_id") % shift_every == 0, (label + 1) % labels).otherwise(label).alias("label")
    rows = stored(whole_vectors(vectors.where(label.isNotNull()), scale, moved), "vectors")
    anchor = F.col("vec_id") % anchor_every == 0
    fitted = centroids(bounded_sample(rows.where(anchor), SAMPLE_VALUES))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows = stored(rows.mapInArrow(_placed(fitted), f"{kinds}, cluster int, near double"), "placed")
    # One row for each centroid; how far its members go from it.
    far = rows.where(anchor & (F.col("cluster") >= 0)).groupBy("size", "cluster").agg(F.min("near").alias("near")).collect()
    lists = Lists(fitted, {(r["size"], r["cluster"]): float(np.arccos(r["near"])) for r in far})

    by = ["size", "label", "cluster", F.col("norm").desc(), "vec_id"]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    segments = packed(ordered, ["size", "label"], ROWS, "label long", lambda t, _: {"label": _first(t, "label")})
    segments = stored(segments, "segments")
    peaks = stored(segments.mapInArrow(_peaks(lists), "segment long, size int, label long, cluster int, peak double, n int"), "peaks")
    segments = segments.drop("label")

    def pairs(blocks: DataFrame, among: DataFrame, same_label: bool) -> DataFrame:
        """Blocks and the segments of their cluster's list that can matter to one of their members."""
        b = blocks.select(F.col("part").alias("block"), "size", "label", "cluster", "need")
        p = among.select("segment", "peak", *[F.col(c).alias(f"_{c}") for c in ("size", "label", "cluster")])
        met_ = (b["size"] == p["_size"]) & (b["cluster"] == p["_cluster"]) & (p["peak"] >= b["need"])
        met_ &= (b["label"] == p["_label"]) if same_label else (b["label"] != p["_label"])
        return b.join(broadcast_if_small(p), met_).select("block", "segment")

    asked = rows.where(anchor).drop("near")
    unknown = asked.withColumns({"least": F.lit(int(NOTHING)), "need": F.lit(ANY)})
    blocks = _blocks(unknown, _anchors, _MEMBERS)
    heads = stored(peaks.groupBy("size", "label", "cluster").agg(F.max_by(F.struct("segment", "peak"), F.struct("peak", "n", "segment")).alias("h")).select("size", "label", "cluster", "h.*"), "heads")
    search = _walks(lists, positives, "anchors")
    lead = stored(met(blocks, pairs(blocks, heads, True), segments, search, HITS, ["cluster"]), "first-positives")
    reached = ranked(lead, ["anchor_id"], positives, "score", "vec_id").where(F.col("rank") == positives)
    known = unknown.drop("least", "need").join(reached.select(F.col("anchor_id").alias("vec_id"), F.col("score").alias("least")), "vec_id", "left")
    known = known.withColumn("need", _need(F.col("least"), F.col("norm"))).withColumn("least", F.coalesce("least", F.lit(int(NOTHING))))
    blocks = _blocks(known, _anchors, _MEMBERS)
    tails = peaks.join(broadcast_if_small(heads.select("segment", "cluster")), ["segment", "cluster"], "left_anti")
    rest = met(blocks, pairs(blocks, tails, True), segments, search, HITS, ["cluster"])
    nearest = stored(ranked(lead.unionByName(rest), ["anchor_id"], positives, "score", "vec_id").where("score >= 0"), "positives")

    of_anchor = nearest.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list(F.struct("vec_id", "score"))).alias("positives"), F.min("score").alias("_least")
    )
    windowed = asked.join(of_anchor, "vec_id")
    lowest = F.col("_least") - F.floor(F.col("_least") / 5)
    windowed = windowed.withColumn("need", _need(lowest, F.col("norm"))).withColumn("least", lowest).drop("_least")
    blocks = _blocks(windowed, _windows, _MEMBERS + ", anchor binary, positive binary, highest binary")
    hits = met(blocks, pairs(blocks, peaks, False), segments, _walks(lists, negatives, "positives"), HITS, ["cluster"])
    first = ranked(hits, ["anchor_id", "positive_id"], negatives, "score", "vec_id")
    return first.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
