"""Word n-gram Jaccard join by T-occurrence search (DivideSkip), exact.

Two sets with Jaccard similarity of ``percent`` or more share at least T = ceil(percent * (m + n) / (100 + percent))
shingles, so a document is found by counting in how many of the query's inverted lists it occurs. DivideSkip counts over the
short lists only, with the threshold lowered by the number of long lists, and looks the survivors up in the long lists by
binary search.

On Spark this happens in three steps:

1. Every document becomes a set of 64-bit shingle hashes. Equal sets are one class (128-bit signature) from then on.
   The most frequent shingles are counted (a fixed number of them; they fix the order of the lists and nothing else).
2. Rarest first, a class is entered under the shingles of which one at least must be shared with any partner:
   n - ceil(percent * n / 100) + 1 of them. Lists with one class only are dropped. Two classes of a list are tied if their
   sizes allow a link and their marks do: a mark has a byte for every few shingles, the exclusive or of the hashes in one range,
   so each shingle that only one of them has changes one byte at most, and marks that differ in more bytes than a link
   leaves shingles to differ rule it out for certain. Tied classes, followed to the end, form a search group; linked classes are
   always in one. Short lists are paired off by a join (15 / 2 pairs for an entry at most), long ones are compared in blocks.
3. A group is searched as a whole, with inverted lists over all its shingles. Small groups share a task; a large one is cut into
   blocks and each pair of blocks is a task, whatever the group's size. Tasks return counts and spanning trees, never pairs.

Links and copies are then joined up by distributed connected components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfeed.llm.common import Words, cast_array, steps, stored
from regfeed.llm.components import Forest, components
from regfeed.session import broadcast_if_small

# Shingles whose frequency is known when lists are ordered.
FREQUENT = 200_000
# A batch reports a shingle that it has this often.
OFTEN = 3
# Classes of a list that is paired off by a join; entries of a block of a longer one.
SHORT_LIST, BLOCK_ENTRIES = 16, 1_024
# Shingles of a block; a task holds two blocks.
BLOCK_SHINGLES = 400_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word windows, ASCII capitals lowered.

    A text of fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    words = Words(texts)
    if not len(words.index):
        return [np.zeros(0, np.uint64)] * len(words)
    hashed = pd.util.hash_array(pc.ascii_lower(words.distinct).to_numpy(zero_copy_only=False).astype(object), categorize=False)
    each = hashed[words.index]
    count = max(0, len(each) - width + 1)
    rolled = np.zeros(count, np.uint64)
    for k in range(width):
        rolled = rolled * MULTIPLIER + each[k : k + count]
    rolled = _mixed(rolled)
    out = []
    for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for k in range(a, b):
                short = short * MULTIPLIER + each[k]
            out.append(_mixed(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _signature(shingles: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64).tolist())


def least_overlap(n, percent: int):
    """Shingles of a set of ``n`` that any partner shares at least."""
    return -(-percent * n // 100)


def mark(shingles: np.ndarray, percent: int) -> np.ndarray:
    """A byte for each of the hash ranges: a power of two of them, at least 8 and 1.8 times what a link leaves to differ.

    Sets with little in common then differ in nearly all bytes, about half of which are enough to rule a link out.
    """
    parts = 1 << max(3, int(np.ceil(np.log2(max(1.0, 1.8 * most_apart(len(shingles), len(shingles), percent))))))
    out = np.zeros(parts, np.uint8)
    if len(shingles):
        place = (shingles >> np.uint64(65 - parts.bit_length())).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        out[place[starts]] = np.bitwise_xor.reduceat((shingles & np.uint64(0xFF)).astype(np.uint8) | np.uint8(1), starts)
    return out


def most_apart(m, n, percent: int):
    """Shingles that only one of two linked sets of sizes ``m`` and ``n`` has, at most."""
    return m + n - 2 * -(-percent * (m + n) // (100 + percent))


def may_link(marks: list[np.ndarray], sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that sizes and marks do not rule out, each once, some rows at a time."""
    parts = np.array([len(x) for x in marks])
    for level in np.unique(parts).tolist():
        own, finer = np.flatnonzero(parts == level), np.flatnonzero(parts > level)
        rows = np.concatenate([own, finer])
        table = np.stack([np.bitwise_xor.reduce(marks[k].reshape(level, -1), axis=1) for k in rows])
        chunk = max(1, (4 << 20) // (len(rows) * level))
        for a in range(0, len(own), chunk):
            apart = (table[a : min(a + chunk, len(own)), None, :] != table[None, :, :]).sum(2)
            m, n = sizes[own[a : a + chunk]][:, None], sizes[rows][None, :]
            fits = (apart <= most_apart(m, n, percent)) & (100 * np.minimum(m, n) >= percent * np.maximum(m, n))
            # Pairs within the level are met from both sides, pairs with finer ones from this side only.
            fits &= (np.arange(len(rows))[None, :] >= len(own)) | (np.arange(len(rows))[None, :] < np.arange(a, a + len(m))[:, None])
            x, y = np.nonzero(fits)
            yield own[a + x], rows[y]


def _describe(width: int, percent: int):
    """Per document: size, signature and mark; besides, shingles that many documents of a batch have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            sets = shingle_sets(batch.column("text"), width)
            rows = [(len(s), *_signature(s)) for s in sets]
            found, seen = np.unique(np.concatenate(sets), return_counts=True)
            found, seen = found[seen >= OFTEN].view(np.int64), seen[seen >= OFTEN]
            none = [None] * len(found)
            n, cls, check = (list(x) + none for x in zip(*rows, strict=True))
            nothing = [None] * len(rows)
            columns = [cast_array(batch.column("doc_id"), pa.int64()).to_pylist() + none, n, cls, check]
            columns += [nothing + found.tolist(), nothing + seen.tolist()]
            names = ["doc_id", "n", "cls", "chk", "shingle", "seen", "mark"]
            marks = pa.array([mark(s, percent).tobytes() for s in sets] + none, pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), marks], names)

    return run


def _entries(width: int, percent: int, frequent: np.ndarray):
    """(shingle, class) for the rarest shingles of each document. ``frequent``: hashes, rarest first."""
    by_hash = np.argsort(frequent)
    known = frequent[by_hash]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            sets = [s for s in shingle_sets(batch.column("text"), width) if len(s)]
            if not sets:
                continue
            sizes = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets)), sizes)
            wanted = sizes - least_overlap(sizes, percent) + 1
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                common = known[at] == flat
            else:
                at, common = np.zeros(len(flat), np.int64), np.zeros(len(flat), bool)
            rare = np.cumsum(~common)
            first = np.cumsum(sizes) - sizes
            number = rare - (rare[first] - ~common[first])[doc]  # from 1 among the document's rare ones
            chosen = ~common & (number <= wanted[doc])
            short = wanted - np.bincount(doc[~common], minlength=len(sets))
            for d in np.flatnonzero(short > 0):
                own = np.arange(first[d], first[d] + sizes[d])[common[first[d] : first[d] + sizes[d]]]
                chosen[own[np.argsort(by_hash[at[own]])[: short[d]]]] = True
            cls = np.array([_signature(s)[0] for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat[chosen].view(np.int64)), pa.array(cls[doc[chosen]])], ["shingle", "cls"])

    return run


def _pair_fits(percent: int):
    """Of the pairs of short lists, those that marks do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "n2"))
            kept = []
            for x, y in zip(batch.column("mark").to_pylist(), batch.column("mark2").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                parts = min(len(x), len(y))
                kept.append(np.count_nonzero(np.bitwise_xor.reduce(x.reshape(parts, -1), axis=1) != np.bitwise_xor.reduce(y.reshape(parts, -1), axis=1)))
            fits = pa.array(np.array(kept, np.int64) <= most_apart(m, n, percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(fits) for c in ("a", "b")], ["a", "b"])

    return run


def _list_ties(percent: int):
    """Spanning trees of the pairs of long lists that sizes and marks do not rule out."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby(["shingle", "low", "high"], sort=False):
            ids = part["cls"].to_numpy()
            forest = Forest(len(ids))
            for x, y in may_link([np.frombuffer(b, np.uint8) for b in part["mark"]], part["n"].to_numpy(), percent):
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    forest.union(i, j)
            out.append(pd.DataFrame({"a": ids, "b": ids[[forest.find(k) for k in range(len(ids))]]}))
        every = pd.concat(out)
        return every[every["a"] != every["b"]]

    return run


def _ties(entries: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """``a, b``: classes tied directly, or by a tree of direct ties. ``marks``: ``cls, n, mark``, one row per class."""
    shared = entries.groupBy("shingle").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least != most")
    met = stored(entries.join(shared.select("shingle"), "shingle").distinct().join(marks.select("cls", "n"), "cls"), "met")
    sizes = met.groupBy("shingle").agg(F.count("*").alias("size"))
    sized = stored(met.join(sizes, "shingle"), "lists")
    short = sized.where(F.col("size") <= SHORT_LIST)
    other = short.select("shingle", F.col("cls").alias("b"), F.col("n").alias("n2"))
    near = (F.col("cls") < F.col("b")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
    pairs = short.join(other, "shingle").where(near).select(F.col("cls").alias("a"), "b", "n", "n2").distinct()
    one = marks.select(F.col("cls").alias("a"), "mark")
    two = marks.select(F.col("cls").alias("b"), F.col("mark").alias("mark2"))
    paired = pairs.join(one, "a").join(two, "b").select("a", "b", "n", "n2", "mark", "mark2").mapInArrow(_pair_fits(percent), "a long, b long")

    long = sized.where(F.col("size") > SHORT_LIST).withColumn("blocks", F.ceil(F.col("size") / BLOCK_ENTRIES).cast("long"))
    long = long.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    long = long.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    long = long.select("shingle", "cls", "n", "blocks", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    cells = max(1, -(-long.count() // (16 * BLOCK_ENTRIES)))
    cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("shingle"), F.lit(cells))).otherwise(F.xxhash64("shingle", "low", "high"))
    listed = long.join(marks.select("cls", "mark"), "cls").withColumn("cell", cell)
    return paired.unionByName(listed.groupBy("cell").applyInPandas(_list_ties(percent), "a long, b long"))


def _with_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            sets = shingle_sets(batch.column("text"), width)
            kept = [batch.column(c) for c in ("doc_id", "copies", "grp", "blocks")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "copies", "grp", "blocks", "shingles"])

    return run


def divide_skip(sets: list[np.ndarray], copies: np.ndarray, block: np.ndarray, across: bool, percent: int) -> tuple[np.ndarray, Forest]:
    """Links of each set (weighted by copies) and their spanning forest. ``across``: only between different blocks."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[k]) for k in order])
    many = len(sets)
    lists, number = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    owner = np.repeat(np.arange(many), sizes)
    by = np.argsort(number, kind="stable")
    posting, entry = owner[by], number[by].astype(np.int64) * many + owner[by]
    length = np.bincount(number, minlength=len(lists))
    begin = np.cumsum(length) - length
    first = np.cumsum(sizes) - sizes
    links, forest = np.zeros(many, np.int64), Forest(many)
    copies, block = copies[order], block[order]
    for x in range(many):
        n = int(sizes[x])
        own = number[first[x] : first[x] + n]
        own = own[length[own] > 1]
        need = least_overlap(n, percent)
        if len(own) < need:
            continue
        own = own[np.argsort(length[own], kind="stable")]
        long = min(need - 1, int(need / (np.log2(length[own[-1]]) + 1)))
        short, rest = own[: len(own) - long], own[len(own) - long :]
        # Merging the short lists: how often each id occurs in them.
        lens = length[short]
        at = np.repeat(begin[short] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        met = np.bincount(posting[at], minlength=many)[:x]
        found = np.flatnonzero(met >= need - long)
        found = found[sizes[found] * 100 >= percent * n]
        if across:
            found = found[block[found] != block[x]]
        if not len(found):
            continue
        shared = met[found]
        if long:
            probe = rest[:, None] * many + found[None, :]
            place = np.minimum(np.searchsorted(entry, probe), len(entry) - 1)
            shared = shared + (entry[place] == probe).sum(0)
        found = found[shared * (100 + percent) >= percent * (n + sizes[found])]
        links[x] += copies[found].sum()
        links[found] += copies[x]
        for y in found.tolist():
            forest.union(x, y)
    back, up = np.empty(many, np.int64), np.empty(many, np.int64)
    back[order] = links
    up[order] = [order[forest.find(k)] for k in range(many)]
    whole = Forest(many)
    whole.up = up.tolist()
    return back, whole


def _search(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby(["grp", "low", "high"], sort=False):
            sets = [np.frombuffer(b, np.uint64) for b in part["shingles"]]
            ids = part["doc_id"].to_numpy()
            links, forest = divide_skip(sets, part["copies"].to_numpy(), part["block"].to_numpy(), part["low"].iat[0] != part["high"].iat[0], percent)
            out.append(pd.DataFrame({"doc_id": ids, "links": links, "root": ids[[forest.find(k) for k in range(len(ids))]]}))
        return pd.concat(out)

    return run


def jaccard_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, n_links, component_id``, one row for each row of ``docs``.

    Words are separated by blanks (space, U+0009 to U+000D). Two documents are linked when 100 * shared >= percent * united
    distinct shingles; ``n_links`` counts the documents linked directly, ``component_id`` is the smallest doc_id reachable.
    A NULL, empty or blank text has no shingles and no links. Rows of one ``doc_id`` count as one document. A NULL
    ``doc_id`` stays with component NULL and no links. Other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = "doc_id long, n long, cls long, chk long, shingle long, seen long, mark binary"
    told = stored(texts.mapInArrow(_describe(width, percent), kinds), "described")
    marked = told.where("n is not null")
    sizes = marked.select("doc_id", "n", "cls", "chk")
    seen = told.where("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("seen"))
    top = seen.orderBy(F.desc("seen"), "shingle").limit(FREQUENT).toPandas()
    frequent = top["shingle"].to_numpy(np.int64)[::-1].view(np.uint64).copy() if len(top) else np.zeros(0, np.uint64)

    classes = sizes.where("n > 0 and doc_id is not null").groupBy("n", "cls", "chk")
    classes = stored(classes.agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("copies")), "classes")

    entries = stored(texts.where("doc_id is not null").mapInArrow(_entries(width, percent, frequent), "shingle long, cls long"), "entries")
    # Two classes with equal 64 bits would share a mark here and be told apart by their sets later on.
    marks = marked.join(classes.select(F.col("rep").alias("doc_id"), "cls", "chk"), ["doc_id", "cls", "chk"]).dropDuplicates(["cls"])
    marks = stored(marks.select("cls", "n", "mark"), "marks")
    tied = components(_ties(entries, marks, percent), "a", "b")
    tied = tied.unionByName(tied.select(F.col("component").alias("id"), "component").distinct())
    members = classes.join(tied, F.col("cls") == F.col("id")).select("rep", "n", "copies", F.col("component").alias("grp"))
    groups = members.groupBy("grp").agg(F.sum("n").alias("total"))
    groups = groups.select("grp", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    members = stored(members.join(groups, "grp"), "members")

    total = members.agg(F.sum("n")).first()[0] or 0
    cells = max(1, -(-total // BLOCK_SHINGLES))
    wanted = broadcast_if_small(members.select("rep", "copies", "grp", "blocks"))
    sets = texts.join(wanted, F.col("doc_id") == F.col("rep")).select("doc_id", "text", "copies", "grp", "blocks")
    sets = sets.mapInArrow(_with_sets(width), "doc_id long, copies long, grp long, blocks int, shingles binary")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("long")))
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    sets = sets.select(
        "doc_id", "copies", "grp", "shingles", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("grp"), F.lit(cells))).otherwise(F.xxhash64("grp", F.least("block", "other"), F.greatest("block", "other"))).alias("cell"),
    )
    found = stored(sets.groupBy("cell").applyInPandas(_search(percent), "doc_id long, links long, root long"), "links")
    direct = found.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(found, "doc_id", "root").select(F.col("id").alias("rep"), "component")
    known = classes.join(direct, "rep", "left").join(joined, "rep", "left")
    known = known.select("n", "cls", "chk", "copies", "rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    empty = F.col("n") == 0
    out = sizes.join(known, ["n", "cls", "chk"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull() | empty, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).alias("n_links"),
        F.when(empty, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )
