"""Records cut across transport chunks.

Chunk borders fall anywhere, so a record may start in one chunk and end several later. The number of newlines before
a chunk gives the record number of its first fragment; fragments with the same number are one record. Nothing is
carried from chunk to chunk, so a feed is put together by many tasks at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfeed.operators.scan import running_total


def cut(lines: DataFrame, size: int, order: str = "timepoint", text: str = "line") -> DataFrame:
    """Chunks of ``size`` characters of each feed's newline-terminated lines: (stream_path, seq, chunk)."""
    ended = lines.select("stream_path", order, F.concat(F.col(text), F.lit("\n")).alias("_text"))
    placed = running_total(ended, ["stream_path"], [order], F.length("_text"), "_start", before=True)
    first = F.floor(F.col("_start") / size)
    last = F.floor((F.col("_start") + F.length("_text") - 1) / size)
    pieces = placed.withColumn("seq", F.explode(F.sequence(first, last)))
    # The part of the line inside chunk number seq.
    begin = F.greatest(F.col("seq") * size - F.col("_start"), F.lit(0))
    end = F.least((F.col("seq") + 1) * size - F.col("_start"), F.length("_text"))
    piece = F.substring("_text", (begin + 1).cast("int"), (end - begin).cast("int"))
    cuts = pieces.select("stream_path", "seq", "_start", piece.alias("_piece"))
    # A chunk has at most ``size`` characters, whatever the feed's length.
    return cuts.groupBy("stream_path", "seq").agg(F.expr("listagg(_piece, '') within group (order by _start)").alias("chunk"))


def reassemble(chunks: DataFrame, buckets: int | None = None) -> DataFrame:
    """The original lines, numbered from 0 in their feed; the last one need not end in a newline.

    Only newline counts are ordered; the text itself moves once to meet its number and once to its record.
    """
    newlines = F.length("chunk") - F.length(F.replace(F.col("chunk"), F.lit("\n"), F.lit("")))
    marks = chunks.select("stream_path", "seq", newlines.alias("_newlines"))
    placed = running_total(marks, ["stream_path"], ["seq"], F.col("_newlines"), "_first", before=True, buckets=buckets)
    numbered_chunks = chunks.join(placed.select("stream_path", "seq", "_first"), ["stream_path", "seq"])
    pieces = numbered_chunks.select("stream_path", "seq", "_first", F.posexplode(F.split("chunk", "\n", -1)).alias("_at", "_piece"))
    numbered = pieces.where(F.col("_piece") != "").withColumn("line_no", F.col("_first") + F.col("_at"))
    # One record's fragments per group.
    lines = numbered.groupBy("stream_path", "line_no").agg(F.expr("listagg(_piece, '') within group (order by seq)").alias("line"))
    return lines.where(F.trim("line") != "")
