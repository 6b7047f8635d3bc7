"""Token operators against the library itself, text by text."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from regfeed.llm import histogram_pack, huffman_ids, overlap_tokens
from regfeed.llm.common import Words, steps
from regfeed.llm.encode import Encoder, encoder, vocabulary_path
from regfeed.session import work_path

PATH = vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "a\x0bb\x0cc\rd\te\nf", "It's x<|endoftext|>y <|ENDOFTEXT|> don't", "", None, "   ", "é ́a İx ΑΣ ß, STRASSE. ñ.,", " lead", "trail ",
    "漢字かな。カナ 123a1", "a b c\x85d\x1cx", "x" * 300 + " y", "ÿ. Þorn, ×÷ wow!! ok### a|b", "word " * 400,
]
SCHEMA = "doc_id long, text string, source string, n_tokens string, length int"


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(k, t, "s", "clash", 7) for k, t in enumerate(ODD)]
    # A NULL id, repeated rows, one id with two texts.
    rows += [(None, "no id here", None, None, None), (3, "again and again", "s", "", 1), (3, "again and again", "s", "", 1), (5, "other text", "s", "", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_encoder_agrees_with_the_library():
    counts, flat = encoder(PATH).encode(pa.array(ODD, pa.string()))
    ends = np.cumsum(counts)
    for text, n, end in zip(ODD, counts, ends, strict=True):
        assert list(flat[end - n : end]) == ids(text)
    assert list(encoder(PATH).counts(pa.array(ODD, pa.string()))) == [len(ids(t)) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAzéÉßİΣ.,!'|<>#\n\t 12漢́ \x85"), max_size=30), max_size=6))
def test_encoder_on_any_text(texts):
    tiny = TINY
    counts, flat = tiny.encode(pa.array(texts, pa.string()))
    assert flat.tolist() == [i for t in texts for i in ids(t)] and counts.tolist() == [len(ids(t)) for t in texts]


TINY = Encoder(PATH, keep=3)  # a cache that forgets all the time


def test_other_vocabularies_get_whole_texts():
    import public_tokenizers

    other = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_word
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert other.encode(pa.array(["a  b", None]))[1].tolist() == want.encode("a  b", add_special_tokens=False).ids


def test_steps_copy_what_they_cut():
    batch = pa.RecordBatch.from_arrays([pa.array([f"Word {k}" * 50 for k in range(100)])], ["text"])
    cut = list(steps(iter([batch]), "text", most=2_000))
    assert len(cut) > 5 and sum(b.num_rows for b in cut) == 100
    assert [w for b in cut for w in Words(b.column("text")).distinct.to_pylist()][:2] == ["Word", "0Word"]


def test_overlaps_widen_until_they_align(spark, documents):
    extra = [(100, "x" * 900 + " " + "y" * 700, "", "", 0), (101, "漢字" * 400 + " a", "", "", 0), (102, "z" * 1000, "", "", 0), (100, "x" * 900 + " " + "y" * 700, "", "", 0)]
    every = documents.unionByName(spark.createDataFrame(extra, SCHEMA))
    for chunk, overlap in ((200, 16), (64, 4), (32_768, 256)):
        got = overlap_tokens.token_counts(every, chunk=chunk, overlap=overlap, limit=100).collect()
        want = [(d, len((t or "").encode()), len(ids(t))) for d, t in texts_of(every)]
        assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_tokens) for r in got))) == sorted(map(str, want))
        assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_empty_tables(spark, documents):
    none = documents.limit(0)
    assert overlap_tokens.token_counts(none).count() == 0
    assert histogram_pack.pack_documents(none).count() == 0
    assert huffman_ids.round_trip(none).count() == 0


def test_huffman_files_hold_what_was_written(spark, documents, monkeypatch):
    for name, value in (("BLOCK", 64), ("STRIDE", 8), ("PART_IDS", 300), ("STEP_IDS", 200)):
        monkeypatch.setattr(huffman_ids, name, value)
    folder = work_path(spark, "huffman")
    huffman_ids.write_ids(documents, folder)
    got = huffman_ids.read_ids(spark, folder).collect()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted(
        (str(d), np.array([*ids(t), 2], np.uint32).tobytes()) for d, t in texts_of(documents)
    )
    placed = huffman_ids.placed(huffman_ids.read_ids(spark, folder)).orderBy("start").collect()
    at = 0
    for r in placed:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in placed] == sorted((d for d, _ in texts_of(documents)), key=lambda d: -1 if d is None else d)


def kraft(lengths):
    return sum(2.0 ** -int(n) for n in lengths)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10_000), min_size=2, max_size=60), st.integers(6, 20))
def test_code_lengths_are_limited_and_best(counts, limit):
    import heapq

    counts = np.array(counts)
    lengths = huffman_ids.limited_lengths(counts, limit)
    assert lengths.max() <= limit and abs(kraft(lengths) - 1) < 1e-9
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (lengths * counts).sum() >= cost
    if limit == 20:
        assert (lengths * counts).sum() == cost


def test_one_symbol_and_too_many():
    assert huffman_ids.limited_lengths(np.array([5]), 20).tolist() == [1]
    with pytest.raises(ValueError):
        huffman_ids.limited_lengths(np.ones(9, np.int64), 3)


def test_codes_round_trip():
    draw = np.random.default_rng(3)
    values = np.minimum(draw.zipf(1.3, 5_000), 900).astype(np.uint32)
    symbols, counts = np.unique(values, return_counts=True)
    book = huffman_ids.Codebook(symbols, huffman_ids.limited_lengths(counts, 12))
    starts = np.array([0, 700, 2_000])
    data, place = book.encode(values, starts)
    assert (place[starts] % 8 == 0).all()
    at = np.arange(0, 5_000, 100)
    assert (huffman_ids.decode(book.table(), book.widest, data, place[at], np.full(50, 100)) == values).all()


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=30))
def test_patterns_hold_every_length_once(histogram):
    used = {}
    for pattern, count in histogram_pack.shortest_pack_first(histogram, 64):
        assert sum(n * c for n, c in pattern) <= 64
        for n, c in pattern:
            used[n] = used.get(n, 0) + c * count
    assert used == histogram


def test_packing(spark, documents, monkeypatch):
    monkeypatch.setattr(histogram_pack, "BUCKET_ROWS", 4)
    many = documents.unionByName(spark.createDataFrame([(1000 + k, None, "", "", 0) for k in range(50)], SCHEMA))
    got = histogram_pack.pack_documents(many, capacity=64, with_ids=True).collect()
    sequences = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    want = sorted(i for _, t in texts_of(many) for i in [*ids(t), 2])
    assert sorted(i for r in got for i in np.frombuffer(r.ids, np.uint32).tolist()) == want
    again = histogram_pack.pack_documents(many, capacity=64, with_ids=True).collect()
    key = lambda r: (r.sequence_id, r.offset, r.doc_id is None, r.doc_id or 0, r.start, r.length)
    assert sorted(map(key, got)) == sorted(map(key, again))
