"""Packing token sequences into rows of fixed length: shortest pack first over the histogram of lengths.

Documents are cut into pieces of at most ``capacity`` ids. Only the histogram of piece lengths (at most ``capacity``
entries, whatever the corpus) reaches the driver. There lengths are placed longest first, each into the packs that hold
the least so far; what is kept are patterns (which lengths share a pack) and how often each occurs. A length adds two
patterns at most, so the table of slots is bounded by the capacity too. Pieces find their slot by their rank among the
pieces of equal length; ranks are counted per hash bucket, so that a length that a third of all documents share is
spread over many tasks.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regfeed.llm.common import cast_array, steps, stored
from regfeed.llm.encode import encoder, vocabulary_path, with_end

# Pieces that one task ranks.
BUCKET_ROWS = 50_000


def cut_pieces(docs: DataFrame, path: str | None = None, end_id: int = 2, capacity: int = 4_096, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``, little-endian unsigned 32-bit) for each piece.

    A document's ids are those of its whole text (NULL: none) and ``end_id``; an empty text is one piece of one id.
    """
    path = path or vocabulary_path()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in steps(batches, "text"):
            counts, ids = with_end(*encode(batch.column("text")), end_id)
            raw = memoryview(ids.view(np.uint8))
            pieces = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * capacity
            length = np.minimum(counts[row] - start, capacity)
            first = (np.cumsum(counts) - counts)[row] + start
            spans = [(4 * a, 4 * (a + n)) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
            out = [cast_array(batch.column("doc_id"), pa.int64()).take(pa.array(row))]
            out += [pa.array(x, pa.int64()) for x in (start, length, [zlib.crc32(raw[a:b]) for a, b in spans], counts[row])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                out.append(pa.array([bytes(raw[a:b]) for a, b in spans], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ``[(length, copies), ...]`` and how many packs have each."""
    packs: list[tuple[int, int, list, int]] = []  # held so far, age, pattern, packs
    done, age = [], 0

    def put(held: int, pattern: list, count: int) -> None:
        nonlocal age
        if held >= capacity:
            done.append((pattern, count))
        else:
            age += 1
            heapq.heappush(packs, (held, age, pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit into {capacity}")
        while left:
            if packs and packs[0][0] + length <= capacity:
                held, _, pattern, count = heapq.heappop(packs)
                taken = min(count, left)
                if taken < count:
                    put(held, pattern, count - taken)
                # As many copies as keep this pack no fuller than one copy would make the next one.
                level = packs[0][0] if packs else capacity
                copies = max(1, min(left // taken, (capacity - held) // length, (level - held) // length + 1))
                put(held + copies * length, [*pattern, (length, copies)], taken)
                left -= copies * taken
            else:
                copies = min(capacity // length, left)
                taken = left // copies
                put(copies * length, [(length, copies)], taken)
                left -= copies * taken
    return done + [(pattern, count) for _, _, pattern, count in sorted(packs)]


def slots(patterns: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows ``length, first rank, copies, first sequence, offset``, by length and rank: a slot's packs take a run of ranks."""
    out, used, sequence = [], {}, 0
    for pattern, count in patterns:
        offset = 0
        for length, copies in pattern:
            rank = used.get(length, 0)
            out.append((length, rank, copies, sequence, offset))
            used[length] = rank + copies * count
            offset += length * copies
        sequence += count
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 4_096, tie: tuple[str, ...] = ("doc_id", "start", "ids_crc32")) -> DataFrame:
    """``pieces`` (stored; column ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    In a sequence offsets run without gaps from 0. Equal pieces are interchangeable; ``tie`` orders the others, so reruns agree.
    """
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = slots(shortest_pack_first(histogram, capacity))
    lengths, sizes = np.array(sorted(histogram), np.int64), [histogram[n] for n in sorted(histogram)]
    firsts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
    ordinal = firsts[np.searchsorted(lengths, table[:, 0])] + table[:, 1]
    buckets = max(1, -(-sum(sizes) // BUCKET_ROWS))

    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*tie), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "_bucket").count()
    counts = counts.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("length", "_bucket").orderBy(*tie)
    ranked = dealt.join(counts, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1)
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(columns).schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False) + firsts[np.searchsorted(lengths, length)]
            at = np.searchsorted(ordinal, rank, "right") - 1
            _, _, copies, sequence, offset = table[at].T
            pack_of, copy = np.divmod(rank - ordinal[at], copies)
            found = [pa.array(sequence + pack_of), pa.array(offset + copy * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *found], [*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "_rank").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 2, capacity: int = 4_096, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    A NULL text is empty, a NULL or repeated ``doc_id`` is an id like any other, an empty table gives no rows and other
    columns are ignored.
    """
    return pack(stored(cut_pieces(docs, path, end_id, capacity, with_ids), "pieces"), capacity)
