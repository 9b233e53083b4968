"""Wavelet matrices against plain arrays; files against the tokenizer on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkprep.llm import queries, token_files, wavelet
from sparkprep.llm.token_files import Encoder
from sparkprep.llm.wavelet import WaveletMatrix
from sparkprep.session import new_path

FILE = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return Encoder(FILE)


def whole(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def plain(encoder, rows, end_id=2):
    """(doc_id, start, n_tokens, crc) as they should be, for rows with ids that differ."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole(encoder, text), end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def written(spark, frame, **more):
    path = new_path(spark, "test-tokens")
    token_files.write_tokens(frame, path, FILE, end_id=2, **more)
    return path


def read(spark, path):
    rows = token_files.read_tokens(spark, path).collect()
    return sorted(
        ((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in rows), key=lambda r: r[1]
    )


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=1500), st.integers(0, 63), st.data())
def test_wavelet_matrix(numbers, token, data):
    run = np.array(numbers, np.uint16)
    matrix = WaveletMatrix.of(run, 6)
    assert matrix.all().tolist() == numbers
    place = data.draw(st.integers(0, len(numbers)))
    assert matrix.count(token, place) == numbers[:place].count(token)
    assert matrix.find(token).tolist() == [i for i, n in enumerate(numbers) if n == token]
    places = np.arange(place)
    assert matrix.access(places).tolist() == numbers[:place]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 1024, 5000])
def test_wavelet_matrix_at_block_edges(n):
    run = np.random.default_rng(n).integers(0, 1 << 16, n).astype(np.uint16)
    matrix = WaveletMatrix.of(run, 16)
    assert (matrix.all() == run).all()
    assert (matrix.access(np.arange(n)) == run).all()
    assert matrix.count(1 << 20) == 0 and matrix.find(1 << 20).size == 0
    if n:
        assert matrix.find(int(run[-1]))[-1] == n - 1


ODD_TEXT = st.text(
    st.one_of(
        st.sampled_from(list("aAbé'stI IİΣ́  \x1c\x85\t\n\r\x0b\x0c .!0１日")),
        st.characters(exclude_categories=["Cs"]),
    ),
    max_size=60,
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(ODD_TEXT, st.sampled_from(["<|endoftext|>", " <|startoftext|>x", "it's", "\n"])), max_size=5))
def test_words_apart_have_the_ids_of_the_whole_text(encoder, parts):
    text = "".join(parts)
    assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == whole(encoder, text)


def test_long_texts_are_cut_at_white_space_only(encoder, monkeypatch):
    monkeypatch.setattr(token_files, "SLICE_BYTES", 7)
    for text in ("abc def ghi jkl mno", "x" * 50, "a " * 40, " \n" * 20, "äöü日本 語" * 9):
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == whole(encoder, text)


def test_words_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_BYTES", 300)
    encoder = Encoder(FILE)
    text = " ".join(f"word{i % 7}" for i in range(60))
    for _ in range(3):
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == whole(encoder, text)


def test_query_on_the_table(spark, encoder, texts):
    found = queries.QUERIES["op11_token_files"](spark, FOLDER).collect()
    rows = sorted((tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in found))
    assert rows == plain(encoder, texts)


def test_small_shards_give_the_same_documents(spark, encoder, texts, docs):
    path = written(spark, docs(texts), shard_tokens=2000)
    shards = spark.read.parquet(path)
    assert shards.count() > 20
    # One file per shard, and no shard over twice the size but for a long document.
    assert shards.selectExpr("count(DISTINCT _metadata.file_path)").first()[0] == shards.count()
    assert shards.where("n > 4000 AND size(lengths) > 1").count() == 0
    assert read(spark, path) == plain(encoder, texts)


def test_odd_rows(spark, encoder, odd, docs):
    found = read(spark, written(spark, docs(odd), shard_tokens=500))
    assert [r[0] for r in found] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10]
    assert found == plain(encoder, odd)


def test_rows_that_share_an_id_keep_one_order(spark, encoder):
    rows = [(7, f"text {i % 13}") for i in range(300)] + [(None, "none")] * 40 + [(2**63 - 1, "last")]
    found = []
    for parts in (2, 5):
        frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        found.append(read(spark, written(spark, frame, shard_tokens=100)))
    assert found[0] == found[1]
    assert [r[1] for r in found[0]] == np.cumsum([0, *(r[2] for r in found[0])])[:-1].tolist()
    assert found[0][0][0] is None and found[0][-1][0] == 2**63 - 1
    wanted = sorted((r[0] or 0, r[2], r[3]) for r in plain(encoder, rows))
    assert sorted((r[0] or 0, r[2], r[3]) for r in found[0]) == wanted


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    assert read(spark, written(spark, frame)) == []


def test_end_id_must_fit(spark, docs):
    with pytest.raises(ValueError):
        token_files.write_tokens(docs([(1, "a")]), "unused", FILE, end_id=1 << 20)


def test_counting_and_finding_without_decoding(spark, encoder, texts, docs):
    path = written(spark, docs(texts), shard_tokens=5000)
    ids = {d: [*whole(encoder, t), 2] for d, t in texts}
    every = [i for run in ids.values() for i in run]
    common = max(set(every), key=every.count)
    absent = next(i for i in range(49_000) if i not in set(every))
    found = token_files.count_tokens(spark, path, [common, 2, absent, 1 << 17])
    wanted = {common: every.count(common), 2: every.count(2), absent: 0, 1 << 17: 0}
    assert {r.token: r.n for r in found.collect()} == wanted
    places = {(r.doc_id, r.place) for r in token_files.find_token(spark, path, common).collect()}
    assert places == {(d, p) for d, run in ids.items() for p, i in enumerate(run) if i == common}




def test_words_with_a_mark_reuse_the_word(encoder):
    calls = []
    fresh = Encoder(FILE)
    known = fresh.tokenizer.encode
    fresh.tokenizer = type("Counted", (), {"encode": lambda self, t, **k: calls.append(t) or known(t, **k)})()
    for text in ("caffé, éreié. Éß; ñañ) maß?", "plain words, and marks."):
        assert np.frombuffer(fresh.encode(text), fresh.dtype).tolist() == whole(encoder, text)
    # Only the marks themselves are left to the whole tokenizer.
    assert set(calls) <= set(token_files.MARKS)


def test_deals_over_many_hands():
    numbers = np.random.default_rng(3).integers(0, 49_408, 3 * wavelet._HAND + 17).astype(np.uint16)
    matrix = WaveletMatrix.of(numbers, 16)
    assert (matrix.all() == numbers).all()
    places = np.arange(0, len(numbers), 997)
    assert (matrix.access(places) == numbers[places]).all()
    for few in (numbers[:0], numbers[:1], numbers[: wavelet._HAND]):
        assert (WaveletMatrix.of(few, 16).all() == few).all()
