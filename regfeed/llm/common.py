"""Arrow words, stored intermediates and sizes that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from regfeed.session import work_path

# Text that one step inside a Python worker handles at a time; its arrays take about twenty times that.
STEP_BYTES = 4 << 20


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Written once to the shared folder and read back: lineage ends here, and a lost executor costs no recomputation."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cast_array(column: pa.Array, kind: pa.DataType) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column if column.type == kind else pc.cast(column, kind)


def steps(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        part = np.maximum(np.cumsum(sizes) - sizes, 0) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            # Copied: a cast slice keeps offsets that do not begin at 0, which ascii_lower and others take wrongly.
            yield batch if b - a == batch.num_rows else batch.take(pa.array(np.arange(a, b)))


class Words:
    """Blank-separated words (``[^\\x20\\x09-\\x0D]+``) of a batch of texts as numbers into ``distinct``.

    ``index[starts[i]:starts[i + 1]]`` are the words of text i; a null text has none.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(cast_array(texts, pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets -= offsets[0] if len(offsets) else 0
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        # A text that begins or ends with a blank gives an empty first or last word.
        empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
        if empty >= 0:
            real = index != empty
            before = np.concatenate([[0], np.cumsum(real)])
            index, offsets = index[real], before[offsets]
        self.index, self.starts, self.distinct = index, offsets, coded.dictionary

    def __len__(self) -> int:
        return len(self.starts) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)
