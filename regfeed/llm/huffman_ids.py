"""Token ids in canonical, length-limited Huffman code, in ascending order of document, and their reader.

Files (Parquet as the container, its own compression off):

* ``codebook``: ``id, bits``, the code length of every id that occurs. Canonical codes follow from the lengths.
* ``blocks``: one row per document with ``doc_id, n_tokens, bits, block_at, marks``. A document's ids form blocks of at most
  ``BLOCK`` ids; each starts on a byte (``block_at``) and can be decoded alone. ``marks`` holds a bit offset for every
  ``STRIDE`` ids of the document. Rows are sorted by (doc_id, n_tokens, checksum) within ``part``, and parts by doc_id.

Counts are sums over all ids. The driver sees only the counts, at most one per entry of the vocabulary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regfeed.llm.common import cast_array, steps, stored
from regfeed.llm.encode import encoder, vocabulary_path, with_end
from regfeed.session import work_path

MAX_BITS = 20
BLOCK = 65_536
STRIDE = 512
PART_IDS = 16_000_000
STEP_IDS = 2_000_000


def limited_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code length of each symbol (all counts above 0), at most ``limit``: package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    level, kinds = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaves, pairs])
        by = np.argsort(merged, kind="stable")
        level = merged[by]
        kinds.append(by < n)
    lengths, wanted = np.zeros(n, np.int64), 2 * n - 2
    for kind in reversed(kinds):
        own = int(kind[:wanted].sum())
        lengths[:own] += 1
        wanted = 2 * (wanted - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes: by length, then by id, counted upwards."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, lengths = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.widest = int(lengths.max(initial=1))
        ends = np.cumsum(np.int64(1) << (self.widest - lengths))
        size = int(self.ids.max(initial=0)) + 1
        self.code, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[self.ids] = ((ends - (np.int64(1) << (self.widest - lengths))) >> (self.widest - lengths)).astype(np.uint64)
        self.bits[self.ids] = lengths
        self._ends, self._lengths = ends, lengths

    def table(self) -> np.ndarray:
        """For every next ``widest`` bits: id << 8 | length; 0 where no code begins so."""
        entries = (self.ids << 8 | self._lengths).astype(np.int64)
        out = np.zeros(1 << self.widest, np.int64)
        if len(entries):
            out[: self._ends[-1]] = np.repeat(entries, np.int64(1) << (self.widest - self._lengths))
        return out

    def encode(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes, and the bit place of each id; a new byte is begun at each of ``starts`` (places in ``ids``)."""
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(0, np.int64)
        bits = self.bits[ids]
        upto = np.cumsum(bits) - bits
        sizes = np.diff(np.append(upto[starts], upto[-1] + bits[-1]))
        whole = -(-sizes // 8) * 8
        shift = (np.cumsum(whole) - whole) - upto[starts]
        place = upto + np.repeat(shift, np.diff(np.append(starts, len(ids))))
        words = np.zeros(int(whole.sum()) // 64 + 2, np.uint64)
        word, room = place >> 6, 64 - (place & 63) - bits
        code = self.code[ids]
        high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        groups = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        words[word[groups]] = np.bitwise_or.reduceat(high, groups)
        over = np.flatnonzero(room < 0)  # one at most for each word
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return words.byteswap().view(np.uint8)[: int(whole.sum()) // 8], place


def decode(table: np.ndarray, widest: int, data: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ids of all streams in a row: stream i has ``counts[i]`` ids from bit ``at[i]``. Streams advance side by side."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.uint32)
    data = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    ahead = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    order = np.argsort(-counts, kind="stable")
    place, to = at[order].astype(np.int64), (np.cumsum(counts) - counts)[order]
    live = len(order) - np.searchsorted(counts[order][::-1], np.arange(int(counts.max())), "right")
    out, mask = np.empty(total, np.uint32), (1 << widest) - 1
    for step, n in enumerate(live.tolist()):
        p = place[:n]
        entry = table[ahead[p >> 3].astype(np.int64) >> (32 - widest - (p & 7)) & mask]
        out[to[:n] + step] = entry >> 8
        place[:n] = p + (entry & 255)
    return out


def token_ids(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """``doc_id, n_tokens, ids, checksum``: ids of the whole text (NULL: none) and ``end_id``, little-endian.

    Two bytes each if the vocabulary allows it, else four. The checksum is the crc32 of the 32-bit ids.
    """
    path = path or vocabulary_path()
    wide = max(encoder(path).tokenizer.get_vocab_size(), end_id + 1) > 65_536

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in steps(batches, "text"):
            counts, ids = with_end(*encode(batch.column("text")), end_id)
            ends = np.cumsum(counts)
            raw = memoryview(ids.view(np.uint8))
            kept = memoryview((ids if wide else ids.astype(np.uint16)).view(np.uint8))
            size = 4 if wide else 2
            spans = list(zip((ends - counts).tolist(), ends.tolist(), strict=True))
            out = [cast_array(batch.column("doc_id"), pa.int64()), pa.array(counts, pa.int64())]
            out.append(pa.array([bytes(kept[size * a : size * b]) for a, b in spans], pa.binary()))
            out.append(pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans], pa.int64()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids", "checksum"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, checksum long"
    )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about STEP_IDS ids; a longer document comes alone."""
    for batch in batches:
        if batch.num_rows:
            n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            part = (np.cumsum(n) - n) // STEP_IDS
            cuts = np.flatnonzero(np.diff(part)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                yield batch.slice(a, b - a)


def _flat_ids(batch: pa.RecordBatch) -> np.ndarray:
    counts, values = batch.column("n_tokens").to_numpy(zero_copy_only=False), batch.column("ids")
    data = np.frombuffer(b"".join(values.to_pylist()), np.uint8)
    return data.view(np.uint32 if len(data) == 4 * counts.sum() else np.uint16)


def id_counts(ids: DataFrame) -> DataFrame:
    """``id, n`` over all documents; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in _groups(batches):
            more = np.bincount(_flat_ids(batch))
            total = np.pad(total, (0, max(0, len(more) - len(total))))
            total[: len(more)] += more
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    return ids.select("n_tokens", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCKS = "doc_id long, n_tokens long, bits binary, block_at array<long>, marks array<long>, checksum long, part int"


def _encode_rows(book: Codebook, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            counts, ids = batch.column("n_tokens").to_numpy(zero_copy_only=False), _flat_ids(batch)
            first = np.cumsum(counts) - counts
            every = lambda width: [np.arange(a, a + n, width) for a, n in zip(first, counts, strict=True)]
            blocks, marks = every(BLOCK), every(STRIDE)
            data, place = book.encode(ids, np.concatenate(blocks))
            raw, base = data.tobytes(), place[first]
            stops = np.append(base[1:], 8 * len(raw)) // 8
            doc = batch.column("doc_id")
            part = np.searchsorted(bounds, pc.fill_null(doc, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays(
                [
                    doc,
                    batch.column("n_tokens"),
                    pa.array([raw[a:b] for a, b in zip((base // 8).tolist(), stops.tolist(), strict=True)], pa.binary()),
                    pa.array([(place[b] - p) // 8 for b, p in zip(blocks, base, strict=True)], pa.list_(pa.int64())),
                    pa.array([place[m] - p for m, p in zip(marks, base, strict=True)], pa.list_(pa.int64())),
                    batch.column("checksum"),
                    pa.array(part, pa.int32()),
                ],
                ["doc_id", "n_tokens", "bits", "block_at", "marks", "checksum", "part"],
            )

    return run


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, max_bits: int = MAX_BITS) -> None:
    """Encode all documents into ``folder``; repeated rows are written as often as they occur, a NULL ``doc_id`` comes first."""
    spark = docs.sparkSession
    ids = stored(token_ids(docs, path, end_id), "ids")
    counts = id_counts(ids).orderBy("id").toPandas()  # one row per entry of the vocabulary at most
    symbols, n = counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    bits = limited_lengths(n, max_bits)
    lengths = spark.createDataFrame(list(zip(symbols.tolist(), bits.tolist(), strict=True)), "id long, bits long")
    lengths.coalesce(1).write.parquet(f"{folder}/codebook")
    parts = max(1, -(-int(n.sum()) // PART_IDS))
    probs = [k / parts for k in range(1, parts)]
    bounds = np.unique(np.array(ids.approxQuantile("doc_id", probs, 0.1 / parts) if probs else [], np.float64)).astype(np.int64)
    encoded = ids.mapInArrow(_encode_rows(Codebook(symbols, bits), bounds), BLOCKS)
    encoded = encoded.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("doc_id", "n_tokens", "checksum")
    encoded.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """``part, doc_id, n_tokens, ids_crc32`` (and ``ids``, little-endian unsigned 32-bit) as decoded from the files."""
    rows = spark.read.schema("id long, bits long").parquet(f"{folder}/codebook").orderBy("id").toPandas()
    book = Codebook(rows["id"].to_numpy(np.int64), rows["bits"].to_numpy(np.int64))
    widest = book.widest
    ids, bits = book.ids, book.bits[book.ids]
    made: list[np.ndarray] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Codebook(ids, bits).table())
        for batch in _groups(batches):
            counts = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            values = batch.column("bits").to_pylist()
            sizes = np.array([len(v) for v in values], np.int64)
            marks = batch.column("marks")
            per_doc = -(-counts // STRIDE)
            at = marks.flatten().to_numpy(zero_copy_only=False) + np.repeat(8 * (np.cumsum(sizes) - sizes), per_doc)
            number = np.arange(len(at)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
            streams = np.minimum(np.repeat(counts, per_doc) - number * STRIDE, STRIDE)
            found = decode(made[0], widest, np.frombuffer(b"".join(values), np.uint8), at, streams)
            raw, ends = memoryview(found.view(np.uint8)), 4 * np.cumsum(counts)
            spans = list(zip((ends - 4 * counts).tolist(), ends.tolist(), strict=True))
            out = [batch.column("part"), batch.column("doc_id"), batch.column("n_tokens")]
            out.append(pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64()))
            names = ["part", "doc_id", "n_tokens", "ids_crc32"]
            if with_ids:
                out.append(pa.array([bytes(raw[a:b]) for a, b in spans], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").select("part", "doc_id", "n_tokens", "bits", "marks")
    return blocks.mapInArrow(run, "part int, doc_id long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def placed(decoded: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: ``start`` counts the ids of all documents before, in the files' order.

    Parts are ranges of doc_id of bounded size, so a running sum inside each and the totals of the parts before it suffice.
    """
    narrow = stored(decoded.select("part", "doc_id", "n_tokens", "ids_crc32"), "decoded")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per part
    totals = narrow.groupBy("part").agg(F.sum("n_tokens").alias("n")).coalesce(1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("part").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return narrow.join(totals, "part").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write all documents to a new folder in the shared folder and report what is read back.

    NULL texts are empty, an empty table gives no rows, other columns are ignored.
    """
    folder = work_path(docs.sparkSession, "huffman")
    write_ids(docs, folder, path, end_id)
    return placed(read_ids(docs.sparkSession, folder, with_ids=False))
