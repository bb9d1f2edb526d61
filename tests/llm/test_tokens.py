import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.llm import pfor, token_counts, token_files
from tessel.llm.queries import tokenizer_path

ODD = ["a  b", " a", "a ", "a▁b", "a\nb", "a\tb", "", "  ", "ﬁ①", "a　b", "</s>x", "\x00a", "a b", "<|endoftext|> x<|startoftext|>y", "İstanbul ΣΑΣ", "é ́x", "it's'd \x1c x\x85y", "don't 12½² µªº ÀÉß", "x\r\ny", "😀 a😀b", "'S 'T", "ﾊﾟ", "Straße, über. NAÏVE", "\x01 a\x01b", "a" * 5000, "word " * 3000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def encoded(encoder, texts):
    ids, n = encoder.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(n)
    return [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)]


def test_word_encoder_is_the_library(library):
    encoder = token_files.WordEncoder(tokenizer_path("word_bpe_49k.json"), entries=20)
    for _ in range(2):  # with tables that start afresh
        assert encoded(encoder, ODD) == [e.ids for e in library.encode_batch(ODD, add_special_tokens=False)]


def test_words_with_marks_and_added_tokens(library):
    texts = [
        "Hello, World!!! a, b,c, it's. IT'S, don't-- x1, 1, x. ... 'tis' o'' =\u0338 a=\u0338 e\u0301, E\u0301! \u212a, \u0130. a%%%\x0bb,\x1c c;\u00a0d",
        "A<|endoftext|>, <|ENDOFTEXT|>! <|startoftext|>Abc, <|endoftext|", "z~`,^_^ \x7f, q\x7f, [a] (b) {c} <d> |e|", None, "", ",", "A", "a,", "a,\n\nb.\r\n",
    ]
    encoder = token_files.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    assert encoded(encoder, texts) == [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=600, deadline=None)
@given(st.text("aB1,.'!<|> \t\n\x0b\u0301\u00c9\u0338=\u0130\u3002s", max_size=24))
def test_word_encoder_on_marks(text):
    encoder = token_files.word_encoder(tokenizer_path("word_bpe_49k.json"))
    assert encoded(encoder, [text]) == [encoder.tokenizer.encode(text, add_special_tokens=False).ids]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_word_encoder_on_any_text(text):
    from tokenizers import Tokenizer

    encoder = token_files.word_encoder(tokenizer_path("word_bpe_49k.json"))
    text = text.encode("utf-8", "ignore").decode()
    assert encoded(encoder, [text]) == [encoder.tokenizer.encode(text, add_special_tokens=False).ids]
    assert Tokenizer


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(" ab▁\n.é"), max_size=25))
def test_piece_counts_on_spaces(text):
    table = token_counts._table(tokenizer_path("piece_bpe_32k.model"))
    assert table.totals(pa.array([text])).tolist() == [len(table.model.encode(text))]


def test_piece_counts_are_the_library():
    table = token_counts.PieceTable(tokenizer_path("piece_bpe_32k.model"))
    for texts in (ODD, ODD[::-1], ODD[:1], ODD * 3):
        assert table.totals(pa.array(texts)).tolist() == [len(x) for x in table.model.encode(texts)]
    assert table.totals(pa.array([None], pa.string())).tolist() == [0]


def test_token_counts_table(spark):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", None), (None, "a", "z"), (1, "hello world", "x"), (4, "word " * 5000, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_counts.token_counts(df, tokenizer_path("piece_bpe_32k.model")).collect()
    by = {r["doc_id"]: tuple(r)[1:] for r in got}
    assert len(got) == 6 and by[2] == by[3] == (0, 0, False) and by[4][2] and by[1][0] == 11
    assert token_counts.token_counts(df.limit(0), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_token_counts_of_many_blocks(spark, monkeypatch):
    """Blocks of a few texts each, in several tasks, against the library; each distinct pre-token stands in the table once."""
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 60)
    monkeypatch.setattr(token_counts, "BUCKET_TOKENS", 12)
    table = token_counts._table(tokenizer_path("piece_bpe_32k.model"))
    rows = [(k, t) for k, t in enumerate([*ODD, "x" * 100_000, " ".join(f"w{k % 7}" for k in range(30_000))] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("clash")).repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(df, tokenizer_path("piece_bpe_32k.model")).collect()}
    assert got == {k: (len(t.encode()), len(table.model.encode(t))) for k, t in rows}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=300), max_size=6))
def test_segments_round_trip(docs):
    ids = np.array([x for d in docs for x in d], np.uint32)
    keys = [None if k % 3 == 2 else k - 1 for k in range(len(docs))]
    data = pfor.encode_segment(keys, np.array([len(d) for d in docs], np.uint32), ids)
    k, n, back = pfor.decode_segment(data)
    assert k == keys and n.tolist() == [len(d) for d in docs] and back.tolist() == ids.tolist()
    for b in range(-(-len(ids) // pfor.BLOCK)):
        assert pfor.read_block(data, b).tolist() == ids[b * pfor.BLOCK : (b + 1) * pfor.BLOCK].tolist()


def test_outliers_are_exceptions():
    ids = np.arange(256, dtype=np.uint32) % 16
    ids[[3, 200]] = 4_000_000_000
    data = pfor.encode_segment([0], np.array([256], np.uint32), ids)
    assert len(data) < 350
    assert pfor.decode_segment(data)[2].tolist() == ids.tolist()
    with pytest.raises(ValueError):
        pfor.decode_segment(b"x" * 50)
    with pytest.raises(IndexError):
        pfor.read_block(data, 2)


def test_token_files_read_back(spark, tmp_path, library):
    rows = [(7, "Hello, world.", 1), (2, None, 2), (9, "", 3), (None, "a", 4), (7, "again", 5), (5, "long text " * 4000, 6), (-3, "ß", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3)
    path = str(tmp_path / "ids")
    got = token_files.token_file_digests(df, tokenizer_path("word_bpe_49k.json"), 2, path).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for k, t, _ in order:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.token_file_digests(df.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0
