"""Packing, token files and pieces: the libraries' own output and exact round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomspark.llm import packing, pieces, tokenfile
from loomspark.llm.common import TokenizerWords

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXT = st.text(st.sampled_from("aBe .,\n\t'é́ß1_-ΣİK日🙂\x00\x01\x1c\x85 ▁"), max_size=40)


def docs(spark):
    rows = [(3, "of the and.\nthis " * 900), (1, None), (2, ""), (None, "a  b\n"), (3, "of the and.\nthis " * 900), (7, "x" * 20_000), (4, "é ▁ 日本")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "'t' AS tie", "2 AS part")


def plain(path, as_text=False):
    t = Tokenizer.from_file(path)
    if as_text:
        t.encode_special_tokens = True
    return lambda text, end: [*t.encode(text or "", add_special_tokens=False).ids, end]


PLAIN = {(path, as_text): plain(path, as_text) for path in (BYTE, WORD) for as_text in (False, True)}
WORDS = {path: TokenizerWords(path, path == BYTE) for path in (BYTE, WORD)}


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_words_equal_whole_texts(texts):
    for path, own in WORDS.items():
        whole = PLAIN[path, False]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [whole(t, 0)[:-1] for t in texts]


SPECIAL = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "|>", " a", "b. ", "\n"]), max_size=6).map("".join)
AS_TEXT = {path: TokenizerWords(path, path == BYTE, True) for path in (BYTE, WORD)}


@settings(max_examples=100, deadline=None)
@given(st.lists(SPECIAL, max_size=4))
def test_special_tokens_are_the_librarys(texts):
    for path in (BYTE, WORD):
        for own, whole in ((WORDS[path], PLAIN[path, False]), (AS_TEXT[path], PLAIN[path, True])):
            assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [whole(t, 0)[:-1] for t in texts]
    assert np.frombuffer(WORDS[BYTE].encode(["<|endoftext|>"])[0], "<u4").tolist() == [50256]


AGENDA, LIBRARY = pieces.PieceAgenda(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_agenda_equals_library(texts):
    assert AGENDA.encode(texts) == LIBRARY.encode(texts)
    assert AGENDA.decode(AGENDA.encode(texts)) == LIBRARY.decode(LIBRARY.encode(texts)) if texts else True


def test_long_part_uses_the_heap():
    for text in ("ation" * 40, "aaaa" * 30, "the" * 33 + "zq"):
        assert AGENDA.encode([text]) == LIBRARY.encode([text])


@given(st.lists(st.integers(1, 64), max_size=60), st.integers(64, 128))
def test_windows_hold_everything_within_capacity(sizes, capacity):
    at, k = packing.windows(sizes, capacity)
    fill = np.bincount(at, weights=sizes, minlength=k) if sizes else np.zeros(0)
    assert len(at) == len(sizes) and (fill <= capacity).all()
    assert k <= max(1, len(sizes)) if sizes else k == 0


def test_differencing_balances():
    at = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(np.bincount(at, weights=[8, 7, 6, 5, 4]).tolist()) == [14, 16]
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 129, 600).tolist()
    at, k = packing.windows(sizes, 1024)
    assert sum(sizes) / (k * 1024) > 0.95
    with pytest.raises(ValueError):
        packing.windows([2000], 1024)


@given(st.lists(st.integers(1, 128), max_size=60))
def test_places_cover_all_ids_and_cut_little(sizes):
    pieces, k = packing.place(sizes, 128)
    fill, at = {}, {}
    for item, start, length, w, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert length > 0 and offset == fill.get(w, 0)
        fill[w] = offset + length
        at.setdefault(item, []).append((start, length))
    assert set(fill) == set(range(k)) and all(f <= 128 for f in fill.values()) and k <= -(-sum(sizes) // 128) + 1
    for item, size in enumerate(sizes):
        own = sorted(at[item])
        assert own[0][0] == 0 and sum(n for _, n in own) == size and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_most_documents_stay_whole():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1024, 300).tolist()
    pieces, k = packing.place(sizes, 1024)
    assert sum(sizes) / (k * 1024) > 0.98 and len(pieces) < 1.25 * len(sizes)


def test_packing_is_a_partition_of_all_ids(spark):
    whole, table = plain(BYTE), docs(spark)
    rows = packing.pack(table, BYTE).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= 1024
    # every id of every document lies in exactly one piece
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for doc in {d.doc_id for d in table.collect()}:
        copies = [np.array(whole(d.text, 0), "<u4") for d in table.collect() if d.doc_id == doc]
        ids, n = copies[0], len(copies)
        assert all(crc == zlib.crc32(ids[s : s + k].tobytes()) and total == len(ids) for s, k, crc, total in pieces[doc])
        covered = np.zeros(len(ids) + 1, np.int64)
        for start, length, _, _ in pieces[doc]:
            covered[start] += 1
            covered[start + length] -= 1
        assert (covered.cumsum()[:-1] == n).all()
    assert packing.pack(table.where("false"), BYTE).count() == 0


def test_token_file_round_trip(spark, tmp_path):
    whole, table, path = plain(WORD), docs(spark), f"file://{tmp_path}/files"
    tokenfile.write(table, path, WORD, 1)
    rows = sorted(((r.start, r) for r in tokenfile.read(spark, path).collect()), key=lambda x: x[0])
    order = sorted(table.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for _, r in rows] == [r.doc_id for r in order]
    at = 0
    for (start, r), d in zip(rows, order):
        ids = whole(d.text, 1)
        assert (start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenfile.read_document(spark, path, 4) == [whole("é ▁ 日本", 1)]
    assert len(tokenfile.read_document(spark, path, 3)) == 2 and tokenfile.read_document(spark, path, 99) == []
    assert tokenfile.round_trip(table.where("false"), WORD).count() == 0


def test_token_file_with_a_trained_dictionary(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert tokenfile.train_dictionary(table, WORD, 1, 2)
    rows = tokenfile.round_trip(table, WORD).collect()
    whole, texts = plain(WORD), {r.doc_id: r.text for r in table.collect()}
    assert len(rows) == len(texts) and all(r.n_tokens == len(whole(texts[r.doc_id], 1)) for r in rows)


def test_pieces_digests(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    table = docs(spark)
    rows = pieces.digests(table, PIECE).collect()
    for r, d in zip(rows, table.collect()):
        ids = LIBRARY.encode(d.text or "")
        assert tuple(r) == (d.doc_id, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))
    assert pieces.encode(table, PIECE).where("doc_id = 4").first().ids == LIBRARY.encode("é ▁ 日本")
    assert pieces.digests(table.where("false"), PIECE).count() == 0
