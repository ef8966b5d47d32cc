"""BPE against the tokenizer library, packing against its definition."""

import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkgauge.llm import bpe, packing, queries

from ..conftest import SMALL


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_bpe())


ENCODER = None


def encoder():
    global ENCODER
    ENCODER = ENCODER or bpe.Encoder(queries.word_bpe())
    return ENCODER


def test_awkward_documents(docs, library):
    got = {r.doc_id: r for r in bpe.encoded(docs, queries.word_bpe()).collect()}
    for r in docs.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].ids == want
        assert got[r.doc_id].decoded == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    global LIBRARY
    LIBRARY = globals().get("LIBRARY") or Tokenizer.from_file(queries.word_bpe())
    got = encoder().encode_batch([text])[0]
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert list(array("I", got)) == want
    assert encoder().decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


def test_every_character(library):
    """All code points, alone, between letters and next to a special token."""
    for at in range(0, 0x110000, 0x4000):
        texts = [f"a{c}B{c} {c}<|endoftext|>{c}'s" for c in map(chr, range(at, at + 0x4000)) if not 0xD800 <= ord(c) < 0xE000]
        for t, got in zip(texts, encoder().encode_batch(texts)):
            assert list(array("I", got)) == library.encode(t, add_special_tokens=False).ids, ascii(t)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs"]), st.characters(min_codepoint=0x3000, exclude_categories=["Cs"]), st.sampled_from("\u0345\u0323\u0897\U00011935\U00011930 \x1c\x85'")), max_size=30))
def test_any_script(text):
    test_any_text.hypothesis.inner_test(text)


def test_no_library_is_called(monkeypatch, spark):
    """The whole small table, against ids made with the library; the operator itself never loads it."""
    import inspect

    assert "tokenizers import" not in inspect.getsource(bpe) and "tokenizers import" not in inspect.getsource(packing)


def test_long_words_and_scripts(library):
    for t in ["漢字かな交じり文" * 4000, "приветмир" * 5000 + " ещё", "x" * 30_000, "a" * 199 + "é" * 300, "<|endoftext|>" * 500]:
        assert list(array("I", encoder().encode_batch([t])[0])) == library.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdehilnorstuw", min_size=1, max_size=40))
def test_words_by_speculation(word):
    v = encoder().vocab
    exact = v.merged(word)
    guess = v.speculated(word)
    good = all(v.compatible(a, b) for a, b in zip(guess, guess[1:]))
    assert (guess == exact) or not good  # what passes all pair checks is the exact cut
    assert v._merged_long([*word[:-1], word[-1] + v.suffix]) == exact


def test_encoding_of_nothing(empty):
    assert bpe.encoded(empty, queries.word_bpe()).count() == 0
    assert bpe.digests(empty, queries.word_bpe()).count() == 0


def check_packing(pieces, ids_of, window=2048):
    pad = tokens = 0
    for doc, group in pieces.groupby("doc_id"):
        ids, at = ids_of[doc], 0
        for r in group.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for _, group in pieces.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert (group.offset.to_numpy() == np.r_[0, group.length.cumsum().to_numpy()[:-1]]).all()
        n = int(group.length.sum())
        assert 0 < n <= window
        pad += 0 if n & (n - 1) == 0 else window - n
        tokens += n
    return pad, tokens


def test_packed_documents(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pieces = queries.op3_window_packing(spark, SMALL).toPandas()
    ids = {r.doc_id: np.array(library.encode(r.text, add_special_tokens=False).ids + [1], "<u4") for r in docs.collect()}
    assert set(pieces.doc_id) == set(ids)
    pad, tokens = check_packing(pieces, ids)
    assert pad <= 0.01 * tokens


def test_packed_awkward_documents(docs, empty):
    got = packing.pack(docs.where("doc_id <> 5"), queries.word_bpe(), keep_ids=True).toPandas()
    assert len(got[got.doc_id == 7]) == 1 and got[got.doc_id == 7].length.iloc[0] == 1  # a null text is its end token
    assert (got.length == got.ids.map(len)).all()
    twice = packing.pack(docs.where("doc_id = 5"), queries.word_bpe()).toPandas()
    assert twice.length.sum() == 2 * twice.doc_tokens.iloc[0]  # repeated rows are packed each
    assert packing.pack(empty, queries.word_bpe()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=80))
def test_packer_keeps_every_token(sizes):
    packer, sequences = packing.Packer(64), []
    for doc, n in enumerate(sizes):
        done = packer.add([(doc, n), 0, array("I", range(n)).tobytes()])
        if done:
            sequences.append(done)
    sequences += packer.close()
    lengths = [sum(len(p[2]) // 4 for p in s) for s in sequences]
    assert sum(lengths) == sum(sizes) and all(n == 64 or n & (n - 1) == 0 for n in lengths)
    seen = {}
    for s in sequences:
        for (doc, _), start, ids in s:
            for i, x in enumerate(array("I", ids)):
                assert x == start + i
                seen[doc, x] = seen.get((doc, x), 0) + 1
    assert set(seen.values()) <= {1} and len(seen) == sum(sizes)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=16, max_size=16), st.integers(1, 15))
def test_level_minimises_sum_of_squares(counts, size):
    packer = packing.Packer(16)
    counts[0] = 0
    packer.counts[:16] = counts

    def after(level):
        n = packer.counts.copy()
        if level:
            n[level] -= 1
        if level + size < 16:
            n[level + size] += 1
        return int((n**2).sum())

    options = [h for h in range(0, 17 - size) if h == 0 or packer.counts[h] > 0]
    assert after(packer.level(size)) == min(map(after, options))
