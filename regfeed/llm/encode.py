"""Token ids of whole texts, exactly as the tokenizers library gives them, at the cost of the distinct words.

For a vocabulary whose normaliser turns white space into one blank and whose pre-tokenizer drops it, a blank is a
boundary whatever stands around it. A text's ids are then its words' ids in a row, so that each distinct word of a
batch is encoded once, and words met before come from a bounded cache. Any other vocabulary gets whole texts.
"""

from __future__ import annotations

import json
import re
from array import array
from operator import attrgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from regfeed.llm.common import Words, cast_array

VOCABULARY = "word_bpe_49k.json"

# The normaliser and pre-tokenizer for which blanks are proven boundaries.
BLANK_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
BLANK_PRETOKENIZER = {
    "type": "Split",
    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}

# Letters that NFC leaves alone and whose lower case is one letter: ASCII and Latin-1. A run of marks after them is one
# piece of its own; marks that begin a contraction or occur in added tokens are left to the library.
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&*.,:;?]*)")
LONGEST_KEPT = 48
ID = attrgetter("id")


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def blanks_are_boundaries(spec: dict) -> bool:
    """True for the normaliser and pre-tokenizer above, if no added token holds or swallows white space."""
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
    return (
        (spec.get("normalizer") or {}).get("normalizers") == BLANK_NORMALIZERS
        and split[0] == BLANK_PRETOKENIZER
        and [p["type"] for p in split[1:]] == ["ByteLevel"]
        and not split[1].get("use_regex", True)
        and not split[1].get("add_prefix_space", True)
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    )


def byte_letters() -> dict[int, str]:
    """Byte-level form of the Latin-1 letters: printable bytes stand for themselves, the others are counted up from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    of = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return {c: "".join(of[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class Encoder:
    """Ids without begin, end or added tokens; special strings inside a text as the library's default has them."""

    def __init__(self, path: str, keep: int = 200_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = blanks_are_boundaries(spec)
        self.keep = keep
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.letters = byte_letters()
        self.ends: dict[str, bytes] = {}

    def _plain_ids(self, piece: str) -> bytes:
        return array("I", map(ID, self.tokenizer.model.tokenize(piece))).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as bytes; two generations of the cache keep memory bounded and recent words at hand."""
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}
        young, old, plain, ends, letters = self.young, self.old, PLAIN_WORD.fullmatch, self.ends, self.letters
        out: list = list(map(young.get, words))
        hard = []
        for i in [i for i, found in enumerate(out) if found is None]:
            word = words[i]
            ids = old.get(word)
            if ids is None:
                if len(word) > LONGEST_KEPT or not (match := plain(word)):
                    hard.append(i)
                    continue
                core, end = match.groups()
                core = core.lower()
                if core.isascii():
                    # Capitals and marks at the end fall away, so that one entry serves many words.
                    ids = young.get(core) or old.get(core) or self._plain_ids(core)
                    young[core] = ids
                else:
                    ids = self._plain_ids(core.translate(letters))
                if end:
                    if end not in ends:
                        ends[end] = self._plain_ids(end)
                    ids += ends[end]
            out[i] = young[word] = ids
        if hard:
            for i, e in zip(hard, self.tokenizer.encode_batch_fast([words[i] for i in hard], add_special_tokens=False), strict=True):
                out[i] = array("I", e.ids).tobytes()
                if len(words[i]) <= LONGEST_KEPT:
                    young[words[i]] = out[i]
        return out

    def _distinct(self, texts: pa.Array):
        words = Words(texts)
        ids = self._words(words.distinct.to_numpy(zero_copy_only=False).tolist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return words, ids, lengths

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text; null is empty."""
        if not self.by_word:
            return self.encode(texts)[0]
        words, _, lengths = self._distinct(texts)
        upto = np.concatenate([[0], np.cumsum(lengths[words.index])])
        return upto[words.starts[1:]] - upto[words.starts[:-1]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids in a row; null is empty."""
        if not self.by_word:
            whole = pc.fill_null(cast_array(texts, pa.large_string()), "").to_pylist()
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
            return np.array([len(x) for x in found], np.int64), np.concatenate([np.zeros(0, np.uint32), *found])
        words, ids, lengths = self._distinct(texts)
        flat = np.frombuffer(b"".join(ids), np.uint32)
        firsts = np.cumsum(lengths) - lengths
        per_word = lengths[words.index]
        upto = np.concatenate([[0], np.cumsum(per_word)])
        at = np.repeat(firsts[words.index] - upto[:-1], per_word)
        at += np.arange(upto[-1])
        return upto[words.starts[1:]] - upto[words.starts[:-1]], flat[at]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(counts: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    return counts + 1, np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32)
