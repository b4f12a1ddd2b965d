"""Packing and SentencePiece: ids, places, round trips and the best path."""

import json
import time
import zlib
from array import array
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tracewell.llm import packing, pieces
from tracewell.llm.queries import tokenizer

BPE, PIECES = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
ODD = ["", "  ", " a", "a ", " a  b\n\n c ", "x\ny", "don't it's  'll", "a b  c", "é ü\n \n d", "123 abc456 .5!? <|endoftext|> z", "日本語 テキスト ", "\ta\tb \t c", "a  b", "foo.\nBar ...\n", "a.\n\nb c.\n d", "'s 's", "a ᠎b", "\x1c \x1d a", "a<|endoftext|>b <|endoftext|><|endoftext|> c<|endoftext|>\n", "<|endoftext|"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_have_the_ids_of_the_library(whole, text):
    assert list(array("I", packing.encode(text, BPE))) == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.text(alphabet=st.sampled_from("ab Zé'stll.,\n\t 7日! "), max_size=40))
def test_any_text_gives_the_ids_of_the_library(whole, text):
    assert list(array("I", packing.encode(text, BPE))) == whole.encode(text, add_special_tokens=False).ids


def test_given_texts_have_the_ids_of_the_library(whole, sf_texts):
    assert packing.plain_byte_level(json.loads(whole.to_str()))
    for text in sf_texts:
        assert list(array("I", packing.encode(text, BPE))) == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 200_000, "-" * 200_000, "é" * 100_000, "\n" * 100_000, "a1" * 100_000])
def test_long_runs_end_soon(text):
    began = time.process_time()
    assert len(packing.encode(text, BPE)) > 0 and time.process_time() - began < 20


def test_other_files_go_to_their_library():
    from tokenizers import Tokenizer

    other = tokenizer("word_bpe_49k.json")
    assert list(array("I", packing.encode("Some words, and MORE.", other))) == Tokenizer.from_file(other).encode("Some words, and MORE.", add_special_tokens=False).ids


def test_first_fit_decreasing():
    import random

    rng = random.Random(1)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 60))), reverse=True)
        bins, rooms = packing.Bins(len(sizes), 100), []
        for s in sizes:
            at = next((n for n, room in enumerate(rooms) if room >= s), len(rooms))
            if at == len(rooms):
                rooms.append(100)
            rooms[at] -= s
            assert bins.place(s) == at


def test_pack(messy, messy_rows, whole):
    rows = packing.pack(messy, BPE, capacity=64, group_docs=50).collect()
    fill = defaultdict(list)
    docs = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    want = defaultdict(int)
    for i, t in messy_rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 64):
            want[i, a, len(ids[a : a + 64]), zlib.crc32(array("I", ids[a : a + 64]).tobytes()), len(ids)] += 1
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    assert got == want
    total = sum(r.length for r in rows)
    assert len(fill) * 64 < 1.05 * total + 64 * 8


def test_pack_nothing(empty):
    assert packing.pack(empty, BPE).collect() == []


@pytest.fixture(scope="module")
def model():
    return pieces.model_at(PIECES)


@cache
def vocabulary():
    """Scores of the file's pieces with marks as spaces, their ids, and the score of a byte, read apart from the module."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=PIECES)
    plain = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    scores = {m.id_to_piece(i).replace(pieces.MARK, " "): m.get_score(i) for i in plain}
    return scores, {i: m.get_score(i) for i in plain}, min(x for x in scores.values() if x > -1e6) - 10


def best_score(s):
    """The whole table of the dynamic programme, without a window."""
    scores, _, byte = vocabulary()
    best = [0.0] + [float("-inf")] * len(s)
    for i in range(len(s)):
        for j in range(i + 1, min(len(s), i + 16) + 1):
            if s[i:j] in scores:
                best[j] = max(best[j], best[i] + scores[s[i:j]])
        if s[i] not in scores:
            best[i + 1] = max(best[i + 1], best[i] + byte * len(s[i].encode()))
    return best[-1]


def score_of(ids):
    return sum(vocabulary()[1].get(i, vocabulary()[2]) for i in ids)


def encoded(model, *texts):
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    ids, count = model.encode(np.concatenate(data), np.cumsum([0, *map(len, data)]))
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]


def decoded(model, *rows):
    return model.decode(np.array([i for r in rows for i in r], np.int32), np.array([len(r) for r in rows])).to_pylist()


def streamed(model, text):
    return list(model.stream(np.frombuffer(text.encode(), np.uint8)))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeinorst日é😀"), min_size=1, max_size=300))
def test_streaming_viterbi_is_the_best_path(s):
    model = pieces.model_at(PIECES)
    ids = streamed(model, " " + s)
    assert score_of(ids) == pytest.approx(best_score(" " + s)) and decoded(model, ids) == [s]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aeinrst 日é😀▁\n-"), max_size=90), min_size=1, max_size=8))
def test_units_side_by_side_take_the_streamed_path(texts):
    model = pieces.model_at(PIECES)
    rows = encoded(model, *texts)
    assert decoded(model, *rows) == texts
    for t, ids in zip(texts, rows, strict=True):
        assert ids == (streamed(model, " " + t) if t else [])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    model = pieces.model_at(PIECES)
    text = text.encode("utf-8", "ignore").decode()
    assert decoded(model, *encoded(model, text)) == [text]


@pytest.mark.parametrize("n", range(1, 41))
def test_spaces_before_a_word_are_on_the_best_path(model, n):
    for text in (" " * n + "indent", "a" + " " * n + "return x", "a" + " " * n + "b" + " " * (n // 2), " " * n):
        (ids,) = encoded(model, text)
        assert decoded(model, ids) == [text]
        assert score_of(ids) == pytest.approx(best_score(" " + text), rel=1e-12)


@pytest.mark.parametrize("unit", ["a", " ", "-", "internationalisation", "日本語é😀", "\n", "ab▁"])
def test_long_units_take_time_in_proportion(model, unit):
    text = unit * (100_000 // len(unit))
    began = time.process_time()
    (ids,) = encoded(model, text)
    assert time.process_time() - began < 20 and decoded(model, ids) == [text]
    few = (" " + text)[:1500]
    assert score_of(streamed(model, few)) == pytest.approx(best_score(few))


def test_decoding_takes_any_ids(model):
    raw = model.byte_id[list("é".encode())].tolist()
    assert decoded(model, [], raw, raw[:1], [-5, 10**6], encoded(model, "x")[0]) == ["", "é", "\ufffd", "", "x"]


def test_agreement_with_the_library(sf_texts):
    """The file is a BPE model: the library merges by rank, this module takes the best sum of scores. Both spell the same text."""
    from sentencepiece import SentencePieceProcessor

    m, model = SentencePieceProcessor(model_file=PIECES), pieces.model_at(PIECES)
    words = sorted({w for t in sf_texts for w in t.split() if pieces.MARK not in w})[:4000]
    ours, theirs = encoded(model, *words), m.encode(words, num_threads=1)
    same = sum(a == b for a, b in zip(ours, theirs, strict=True)) / len(words)
    print(f"words with the library's ids: {same:.3f}")
    assert decoded(model, *theirs) == words and 0.3 < same <= 1
    assert all(score_of(a) >= score_of(b) - 1e-6 for a, b in zip(ours, theirs, strict=True))


def test_encode_decode(messy, messy_rows, empty):
    out = pieces.decode(pieces.encode(messy, PIECES), PIECES).collect()
    assert sorted((repr(r.doc_id), r.decoded) for r in out) == sorted((repr(i), t or "") for i, t in messy_rows)
    assert all(r.n_ids == 0 for r in out if not r.decoded)
    assert pieces.decode(pieces.encode(empty, PIECES), PIECES).collect() == []
