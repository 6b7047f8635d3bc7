"""Token counts of whole texts, with huge documents encoded as overlapping chunks and spliced exactly.

A document longer than ``chunk`` characters is cut every ``chunk`` characters; each chunk also holds the ``overlap``
characters after it. Chunks are rows of their own, dealt out over all tasks, and are encoded with offsets. Two
neighbours are spliced where both have a token that starts right after a blank inside their common stretch: the
vocabulary drops blanks before it merges anything, so such a place is a boundary in the whole text too, whatever stands
before or after. With b(p) tokens before place p in a chunk, the whole text has

    n(last chunk) + sum over neighbours of (b_left(p) - b_right(p))

tokens. Where no common boundary is found, that pair alone is encoded again with four times the overlap, until one is
found or the stretch reaches the end of the document, which is a boundary for both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regfeed.llm.common import cast_array, steps, stored
from regfeed.llm.encode import encoder, vocabulary_path

BLANKS = frozenset(" \t\n\r\x0b\x0c")
# Chunks encoded at once; the library's offsets take about 200 bytes a token.
AT_ONCE = 16

KEY = ["_doc", "_hash", "_bytes"]
CHUNK = T.StructType(
    [
        T.StructField("_doc", T.LongType()),
        T.StructField("_hash", T.LongType()),
        T.StructField("_bytes", T.LongType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("side", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("ends", T.BooleanType()),
        T.StructField("part", T.StringType()),
    ]
)
ENCODED = T.StructType(
    [*CHUNK.fields[:5], T.StructField("n", T.LongType()), T.StructField("ends", T.BooleanType())]
    + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("head_at", "head_before", "tail_at", "tail_before")]
)


def _rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def _cut(chunk: int, overlap: int, again: bool):
    """Chunks of each document; ``again``: only both sides of the pairs listed in column ``failed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_py()
                key = tuple(batch.column(c)[row].as_py() for c in KEY)
                wanted: list[tuple[int, str, int]] = []
                if again:
                    for i in batch.column("failed")[row].as_py():
                        wanted += [(i, "left", i * chunk), (i, "right", (i + 1) * chunk)]
                else:
                    wanted = [(i, "both", i * chunk) for i in range(-(-len(text) // chunk))]
                out, held = [], 0
                for i, side, start in wanted:
                    stop = start + overlap + (0 if side == "right" else chunk)
                    out.append((*key, i, side, start, stop >= len(text), text[start:stop]))
                    held += stop - start
                    if held > 4 << 20:
                        yield _rows(out, CHUNK)
                        out, held = [], 0
                if out:
                    yield _rows(out, CHUNK)

    return run


def _encode(path: str, chunk: int, overlap: int):
    """Token count of each chunk, and the proven boundaries in its first and last ``overlap`` characters."""

    def boundaries(text: str, starts: np.ndarray, low: int, high: int, first: int, ends: bool) -> tuple[list, list]:
        at, before = [], []
        for k in range(*np.searchsorted(starts, [low, high])):
            p = int(starts[k])
            # The first of the tokens that start here; a place after a blank is a boundary in every context.
            if p and text[p - 1] in BLANKS and (not k or starts[k - 1] < p):
                at.append(first + p)
                before.append(k)
        if ends:
            at.append(first + len(text))
            before.append(len(starts))
        return at, before

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path).tokenizer
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(a, AT_ONCE).to_pylist()
                out = []
                for row, e in zip(part, library.encode_batch([r["part"] for r in part], add_special_tokens=False), strict=True):
                    starts = np.fromiter((s for s, _ in e.offsets), np.int64, len(e.ids))
                    text, first, ends = row["part"], row["start"], row["ends"]
                    head = boundaries(text, starts, 0, overlap, first, ends) if row["side"] != "left" else ([], [])
                    tail = boundaries(text, starts, chunk, chunk + overlap, first, ends) if row["side"] != "right" else ([], [])
                    out.append((*(row[c] for c in [*KEY, "chunk", "side"]), len(starts), ends, *head, *tail))
                yield _rows(out, ENCODED)

    return run


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per pair of neighbours: what the splice adds, NULL where no common boundary is known."""
    l = left.select(*KEY, "chunk", "tail_at", "tail_before")
    r = right.select(*KEY, "chunk", "head_at", "head_before")
    place = F.array_min(F.array_intersect("tail_at", "head_at"))
    before = lambda at, n: F.element_at(n, F.array_position(at, F.col("_p")).cast("int"))
    keys = [*KEY, "chunk"]
    r = r.select(*[F.col(c).alias(f"r{c}") for c in keys], "head_at", "head_before")
    joined = l.join(r, [F.col(c).eqNullSafe(F.col(f"r{c}")) for c in keys])
    return joined.withColumn("_p", place).select(
        *KEY,
        "chunk",
        F.when(F.col("_p").isNotNull(), before("tail_at", "tail_before") - before("head_at", "head_before")).alias("adds"),
    )


def token_counts(
    docs: DataFrame, path: str | None = None, chunk: int = 32_768, overlap: int = 256, limit: int = 2_048
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, n_chunks``, one row for each row of ``docs``.

    Ids are the library's for the whole text, without added tokens. A NULL text is empty: 0 bytes, 0 tokens. Rows with a
    NULL or repeated ``doc_id`` keep their own row; equal rows get equal counts. Other columns are ignored.
    The vocabulary must be one for which blanks are boundaries (``encode.blanks_are_boundaries``).
    """
    path = path or vocabulary_path()
    if not encoder(path).by_word:
        raise ValueError(f"blanks are not proven boundaries for {path}")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sized = sized.withColumn("n_bytes", F.octet_length("text").cast("long"))
    is_long = F.char_length("text") > chunk

    def short_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path).counts
        for batch in steps(batches, "text"):
            n = pa.array(count(batch.column("text")), pa.int64())
            kept = [cast_array(batch.column(c), pa.int64()) for c in ("doc_id", "n_bytes")]
            yield pa.RecordBatch.from_arrays([*kept, n], ["doc_id", "n_bytes", "n_tokens"])

    short = sized.where(~is_long).mapInArrow(short_counts, "doc_id long, n_bytes long, n_tokens long")
    short = short.withColumn("n_chunks", F.lit(1).cast("long"))

    long_docs = sized.where(is_long).select(
        F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"), F.col("n_bytes").alias("_bytes"), "text"
    )
    cut = long_docs.mapInArrow(_cut(chunk, overlap, False), CHUNK).repartition(*KEY, "chunk")
    encoded = stored(cut.mapInArrow(_encode(path, chunk, overlap), ENCODED), "chunks").dropDuplicates([*KEY, "chunk"])
    pairs = stored(_pairs(encoded, encoded.withColumn("chunk", F.col("chunk") - 1)), "pairs")
    spliced = pairs.where("adds is not null")
    failed, wide = pairs.where("adds is null"), overlap
    while not failed.isEmpty():
        wide *= 4
        by_doc = failed.groupBy(*KEY).agg(F.collect_set("chunk").alias("failed"))
        named = by_doc.select(*[F.col(c).alias(f"r{c}") for c in KEY], "failed")
        wanted = long_docs.dropDuplicates(KEY).join(named, [F.col(c).eqNullSafe(F.col(f"r{c}")) for c in KEY])
        cut = wanted.select(*KEY, "text", "failed").mapInArrow(_cut(chunk, wide, True), CHUNK).repartition(*KEY, "chunk", "side")
        sides = stored(cut.mapInArrow(_encode(path, chunk, wide), ENCODED), "widened")
        pairs = stored(_pairs(sides.where("side = 'left'"), sides.where("side = 'right'")), "pairs")
        spliced, failed = spliced.unionByName(pairs.where("adds is not null")), pairs.where("adds is null")

    # Every chunk that reaches the end has no neighbour whose splice would miss it: the one with the highest number counts.
    last = F.max(F.struct("chunk", "n"))
    ends = encoded.groupBy(*KEY).agg(last["n"].alias("n"), (F.max("chunk") + 1).alias("n_chunks"))
    sums = spliced.groupBy(*KEY).agg(F.sum("adds").alias("adds"))
    sums = sums.select(*[F.col(c).alias(f"s{c}") for c in KEY], "adds")
    totals = ends.join(sums, [F.col(c).eqNullSafe(F.col(f"s{c}")) for c in KEY], "left").select(
        *[F.col(c).alias(f"t{c}") for c in KEY], (F.col("n") + F.coalesce("adds", F.lit(0))).alias("n_tokens"), "n_chunks"
    )
    long_counts = (
        long_docs.select(*KEY)
        .join(totals, [F.col(c).eqNullSafe(F.col(f"t{c}")) for c in KEY])
        .select(F.col("_doc").alias("doc_id"), F.col("_bytes").alias("n_bytes"), "n_tokens", "n_chunks")
    )
    both = short.unionByName(long_counts)
    return both.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")
