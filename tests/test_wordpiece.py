"""WordPiece counts against an implementation of their own and against a library's."""

import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import wordpiece
from tesserae.operators import chunking

VOCABULARY = ["[UNK]", "[CLS]", "[SEP]", "a", "ab", "abc", "b", "##a", "##b", "##bc", "##c", "##cab", "cab", "un", "##aff", "##able", "unaffable", "e", "##e", "##é", ".", ",", "$", "中", "##中", "ß", "σ", "##σ", "1", "##23"]


def plain(text: str, vocabulary: set[str]) -> int:
    total = 2 * bool(text)
    for word in wordpiece.words(text):
        at, pieces = 0, 0
        while at < len(word):
            ends = [to for to in range(len(word), at, -1) if ("##" if at else "") + word[at:to] in vocabulary]
            if not ends:
                pieces = 1
                break
            at, pieces = ends[0], pieces + 1
        total += 1 if len(word) > 100 else pieces
    return total


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")

    def build(vocabulary):
        model = tokenizers.models.WordPiece({w: i for i, w in enumerate(vocabulary)}, unk_token="[UNK]", max_input_chars_per_word=100)
        out = tokenizers.Tokenizer(model)
        out.normalizer, out.pre_tokenizer = tokenizers.normalizers.BertNormalizer(), tokenizers.pre_tokenizers.BertPreTokenizer()
        return out

    return build


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aabbccABun.,$ é\té́ß中Σσ123​\x00\n eI", max_size=60))
def test_counts_equal_a_plain_implementation(text):
    assert wordpiece.WordPiece(VOCABULARY)(text) == plain(text, set(VOCABULARY))


def test_counts_equal_a_library(library):
    other, mine, draw = library(VOCABULARY), wordpiece.WordPiece(VOCABULARY), random.Random(4)
    chars = "aaabbbcccABCun.,$ \t\nÉéßΣσς中文豈İI123́​\x00\x85  　«»_^~`한Ⅷ"
    for _ in range(3000):
        text = "".join(draw.choices(chars, k=draw.randrange(1, 40)))
        assert mine(text) == len(other.encode(text, add_special_tokens=False).ids) + 2, repr(text)


def test_odd_texts():
    mine = wordpiece.WordPiece(VOCABULARY)
    assert mine(None) == mine("") == 0 and mine(" \n") == 2 and mine("abcab") == 5 and mine("xyz") == 3
    assert mine("a" * 100) == 102 and mine("a" * 101) == 3
    assert wordpiece.WordPiece([])("a b.") == 5


@pytest.mark.parametrize("size", [1, 7, 64])
def test_parts_lose_nothing(size):
    text = ("abc cab. " * 40 + "x" * 90 + "\n" + "un,aff\t" * 9) * 3
    cut = list(wordpiece.parts(text, size))
    assert "".join(cut) == text and [w for p in cut for w in wordpiece.words(p)] == wordpiece.words(text)


def test_long_texts_and_a_full_memory(monkeypatch):
    mine = wordpiece.WordPiece(VOCABULARY)
    assert mine("unaffable a, " * 300_000) == 2 + 3 * 300_000
    monkeypatch.setattr(wordpiece, "REMEMBERED", 3)
    assert mine("a b c ab abc cab un e 1") == 2 + 9


def test_every_document_as_a_library_counts_it(spark, library):
    public = pytest.importorskip("public_tokenizers")
    import __spark_entry__ as entry

    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    said = [sp.id_to_piece(i) for i in range(259, sp.get_piece_size())]
    other = library(["[UNK]", *dict.fromkeys(p[1:] if p[0] == "▁" else "##" + p for p in said if p != "▁")])
    texts = dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall())
    got = {r.doc_id: (r.n_tokens, r.n_chunks, r.most) for r in entry.queries()["wordpiece_counts"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(texts)
    tokens = lambda t: len(other.encode(t, add_special_tokens=False).ids) + 2 if t else 0
    for key, text in texts.items():
        chunks = chunking.chunk_text(text, chunking.ChunkConfig(256, 50), tokens) if len(text or "") < 3000 else None
        assert got[key][0] == tokens(text)
        if chunks is not None:
            assert got[key][1:] == (len(chunks), max(map(tokens, chunks), default=0))


def test_nulls_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "Abc, cab", 5), (3, "Abc, cab", 5)], "k int, text string, n_tokens int")
    mine = wordpiece.WordPiece(VOCABULARY)
    got = rows.withColumn("n_tokens", wordpiece.count(F.col("text"), mine)).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 5, 5]
    assert rows.where("false").select(wordpiece.count(F.col("text"), mine)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcun. \n", max_size=200), st.integers(3, 20), st.integers(0, 12))
def test_chunks_by_added_counts_equal_chunks_by_whole_counts(text, size, overlap):
    mine = wordpiece.WordPiece(VOCABULARY)
    config = chunking.ChunkConfig(size, min(overlap, size - 1))
    assert chunking.chunk_text(text, config, mine) == chunking.chunk_text(text, config, lambda t: mine(t))
