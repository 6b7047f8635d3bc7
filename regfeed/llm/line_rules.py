"""Line-first cleaning: each line is judged by itself, failing lines go, and documents that lose too much go with them.

A line with a word fails if one of these holds:

* punctuation: its ASCII marks, ``FREE_MARKS`` left out, are more than ``MARKS_PERCENT`` of its characters other than blanks, or it has at least
  ``SENTENCE_WORDS`` words and does not end in a closing mark (behind which quotes and brackets may follow);
* navigation: two or more separators that stand alone between blanks, or nothing but one to five menu words;
* boilerplate: it has one of the phrases that sites put on every page.

A document is rejected by its base figures (fewer than 50 words, or more than half of them inside repeated three-word windows), or
if failing lines hold more than ``LOSS_PERCENT`` of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfeed.llm.common import Words, cast_array, steps

MARKS_PERCENT = 15
FREE_MARKS = 3
SENTENCE_WORDS = 40
LOSS_PERCENT = 30
FEWEST_WORDS = 50
REPEAT_PERCENT = 50

SYMBOLS = "[#*$%&|<>]"
MARKS = r"[!-/:-@\[-`{-~]"
CLOSED = r"[.!?:;…。！？：；][\x22'”’»)\]]*[ \t\r\f\x0b]*$"
SEPARATORS = r"(?:^|[ \t])(?:\||»|›|•|·|>|/|::)(?:[ \t]|$)"
MENU = r"(?i)^[ \t]*(?:(?:home|menu|login|log in|sign in|sign up|register|search|contact|about|next|previous|back|top|share|sitemap)[ \t]*){1,5}$"
BOILERPLATE = (
    r"(?i)all rights reserved|privacy policy|terms of (?:use|service)|cookie policy|accept (?:all )?cookies|enable javascript"
    r"|skip to (?:main )?content|subscribe to our newsletter|click here|follow us on|lorem ipsum"
)


def repeated_words(words: np.ndarray, distinct: int) -> int:
    """Words inside three-word windows that occur twice or more, the first time included."""
    if len(words) < 4:
        return 0
    words = words.astype(np.int64)
    pair = words[:-2] * distinct + words[1:-1]
    if distinct**3 >= 1 << 62:
        known, pair = np.unique(pair, return_inverse=True)
    key = pair * distinct + words[2:]
    ordered = np.argsort(key, kind="stable")
    same = np.diff(key[ordered]) == 0
    again = np.zeros(len(words) - 2, bool)
    again[ordered[1:][same]] = True
    again[ordered[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def _per_document(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[starts[1:]] - upto[starts[:-1]]


def judge(texts: pa.Array, with_text: bool = False) -> dict[str, pa.Array]:
    """The figures and verdicts of each text; ``with_text``: what is left of it too."""
    texts = pc.fill_null(cast_array(texts, pa.large_string()), "")
    words = Words(texts)
    n_words = words.counts
    letters = pc.utf8_length(words.distinct).to_numpy(zero_copy_only=False)[words.index] if len(words.index) else np.zeros(0, np.int64)
    distinct = max(1, len(words.distinct))
    spans = zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True)
    n_repeat = np.array([repeated_words(words.index[a:b], distinct) for a, b in spans], np.int64)

    split = pc.split_pattern(texts, "\n")
    lines = split.flatten()
    starts = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = starts - starts[0]
    inside = Words(lines)
    line_words = inside.counts
    has_word = line_words > 0
    line_letters = _per_document(
        pc.utf8_length(inside.distinct).to_numpy(zero_copy_only=False)[inside.index] if len(inside.index) else np.zeros(0, np.int64), inside.starts
    )
    figure = lambda x: x.to_numpy(zero_copy_only=False)
    marks = figure(pc.count_substring_regex(lines, MARKS)).astype(np.int64)
    failed = 100 * (marks - FREE_MARKS) > MARKS_PERCENT * line_letters
    failed |= (line_words >= SENTENCE_WORDS) & ~figure(pc.match_substring_regex(lines, CLOSED))
    failed |= figure(pc.count_substring_regex(lines, SEPARATORS)) >= 2
    failed |= figure(pc.match_substring_regex(lines, MENU))
    failed |= figure(pc.match_substring_regex(lines, BOILERPLATE))
    failed &= has_word

    code = figure(lines.dictionary_encode().indices).astype(np.int64)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    keys = owner[has_word] * (int(code.max(initial=0)) + 1) + code[has_word]
    fresh = np.bincount(np.unique(keys) // (int(code.max(initial=0)) + 1), minlength=len(starts) - 1)
    n_dup = _per_document(has_word, starts) - fresh
    lost = _per_document(np.where(failed, line_words, 0), starts)

    base_failed = (n_words < FEWEST_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
    kept = ~base_failed & (100 * lost <= LOSS_PERCENT * n_words)
    out = {
        "n_words": n_words,
        "word_chars": _per_document(letters, words.starts),
        "n_symbols": figure(pc.count_substring_regex(texts, SYMBOLS)).astype(np.int64),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": kept,
        "lost_words": lost,
        "failed_lines": _per_document(failed, starts),
    }
    out = {k: pa.array(v, pa.bool_() if v.dtype == bool else pa.int64()) for k, v in out.items()}
    if with_text:
        left = lines.filter(pa.array(~failed))
        ends = np.concatenate([[0], np.cumsum(~failed)])[starts]
        rest = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), left), pa.scalar("\n", pa.large_string()))
        out["clean_text"] = rest.cast(pa.string())
    return out


def line_first(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_words, failed_lines``.

    ``with_text`` adds ``clean_text``, the lines that passed; blank lines stay. A NULL, empty or blank text has no words and is
    rejected; its clean text is empty. Columns of ``docs`` with one of these names are replaced, all others are passed on.
    """
    figures = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_words long, failed_lines long"
    figures += ", clean_text string" if with_text else ""
    names = [f.split()[0] for f in figures.split(", ")]
    given = docs.drop(*names)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema] + [figures])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            found = judge(batch.column("text"), with_text)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(found[n] for n in names)], [*batch.schema.names, *names])

    return given.mapInArrow(run, schema)
