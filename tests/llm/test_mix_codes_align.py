"""Mixing, vector codes and tokenizer alignment against plain loops."""

import hashlib
import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tracewell.llm import alignment, mixing, packing, vector_codes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- mixing


def words(text):
    return len((text or "").encode().split())


def targets_by_loop(sizes):
    """Shares by weight; what is above twice a source's size is shared again among the others."""
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while rest > 1e-9 and open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        rest = 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] > 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def documents(n=900):
    rng = random.Random(5)
    rows = [(i, f"s{int(rng.random() ** 2 * 9)}" if rng.random() < 0.9 else None, "w " * min(4000, int(rng.paretovariate(0.9) * 10))) for i in range(n)]
    return rows + rows[:40] + [(None, "s1", "a b c"), (None, "s1", None), (7, "z", None), (8, "z", ""), (9, "é", "one")]


SOURCES = "doc_id long, source string, text string, size string, taken int, place string, key string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, "p", "k") for r in rows], SOURCES).repartition(parts)


def test_mix(spark):
    rows = documents()
    out = mixing.mix(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((i, s, words(t)) for i, s, t in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    want = targets_by_loop(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
    for s, x in want.items():
        assert abs(taken[s] - x) <= max(1, 0.01 * x) or s == "é"
    again = mixing.mix(frame(spark, rows[::-1], 7)).collect()
    assert Counter(again) == Counter(out)


def test_mix_certain_copies_and_length_classes(spark):
    rows = [(i, "a", "w " * (50 + i % 100)) for i in range(3000)] + [(i, "b", "w " * (400 + i % 50)) for i in range(400)]
    out = mixing.mix(frame(spark, rows)).collect()
    for s in "ab":
        own = [r for r in out if r.source == s]
        rate = own[0].target / own[0].source_size
        times = [r.taken // r.size for r in own]
        assert min(times) >= math.floor(rate) and max(times) <= math.ceil(rate)
        longs = [r for r in own if r.size >= 100] if s == "a" else own
        assert abs(sum(r.taken for r in longs) / sum(r.size for r in longs) - rate) < 0.02


def test_mix_priority(spark):
    from pyspark.sql import functions as F

    rows = [(i, "a" if i % 2 else "b", "w " * 20) for i in range(2000)]
    out = {r.doc_id: r for r in mixing.mix(frame(spark, rows), F.expr("if(doc_id % 5 = 0, 3, if(doc_id % 5 = 1, null, 1))"), share=0.4).collect()}
    high, low = (np.mean([r.taken / r.size for i, r in out.items() if (i % 5 == 0) == x]) for x in (True, False))
    assert 2.5 < high / low < 3.5
    for s in "ab":
        assert abs(sum(r.taken for r in out.values() if r.source == s) - next(r.target for r in out.values() if r.source == s)) <= 20


@pytest.mark.parametrize("bins", [2, 5])
def test_cuts_equal_a_walk(spark, monkeypatch, bins):
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "BINS", bins)
    rng = random.Random(2)
    rows = [(rng.randint(0, 3), rng.randint(0, 2), rng.choice([rng.random(), 0.5, 0.0]), i, rng.randint(1, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "place long, kind int, v double, doc_id long, words long").withColumn("key", F.struct("v", "doc_id", F.col("words").alias("size")))
    wants = df.groupBy("place", "kind").agg((F.sum("words") * 0.37 + 1e-6).alias("want"))
    got = {(r.place, r.kind): tuple(r.cut) for r in mixing.cuts(df, wants, []).collect()}
    for place in range(4):
        for kind in range(3):
            own = sorted((v, d, w) for p, k, v, d, w in rows if (p, k) == (place, kind))
            left, picked = sum(w for *_, w in own) * 0.37 + 1e-6, []
            for x in own:
                left -= x[2]
                if left < 0:
                    break
                picked.append(x)
            cut = got[place, kind]
            assert [x for x in own if (x[0], -1 if cut[1] is None else x[1]) <= (cut[0], -2 if cut[1] is None else cut[1])] == picked


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [], 1)).collect() == []
    out = mixing.mix(frame(spark, [(1, "a", None), (2, None, " \n")], 1)).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in out) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


# --- vector codes


def codes_by_loop(rows, parts=16, entries=64, rounds=2):
    kept = [(i, l, [math.floor(int(x * 2**200) * 256 / 2**200) if abs(x) < 1e3 else int(x) * 256 for x in v]) for i, v, l in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[2]))
    if not first:
        return []
    width = len(first[0][2])
    kept = [r for r in kept if len(r[2]) == width]
    first = [r for r in first if len(r[2]) == width][:entries]
    edges = [width * p // parts for p in range(parts + 1)]
    cut = lambda v: [v[a:b] for a, b in zip(edges, edges[1:])]
    books = [list(x) for x in zip(*(cut(r[2]) for r in first))]

    def near(x, book):
        d = [sum((a - c) ** 2 for a, c in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for r in kept:
                x = cut(r[2])[p]
                groups[near(x, books[p])[0]].append(x)
            books[p] = [[sum(c) // len(c) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    out, total = [], Counter()
    for i, label, v in kept:
        found = [near(x, b) for x, b in zip(cut(v), books)]
        error = sum(d for _, d in found)
        total[label] += error
        out.append((i, "".join(f"{k:02x}" for k, _ in found), min(error, vector_codes.TOP), label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, min(total[x], vector_codes.TOP), digest) for i, c, e, x in out]


VECTORS = "vec_id long, embedding array<float>, label int, code string, at int, best string"


def coded(spark, rows, **more):
    df = spark.createDataFrame([(*r, "c", 1, "b") for r in rows], VECTORS).repartition(3)
    return [(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df, **more).collect()]


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("width", [32, 16, 21, 5])
def test_codes(spark, width):
    rng = np.random.default_rng(width)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, rng.choice([0.1, 3]), width)], int(rng.integers(0, 4)) if i % 7 else None) for i in rng.permutation(200).tolist()]
    rows += rows[:9] + [(3, rows[0][1], 1), (None, rows[1][1], None), (900, None, 1), (-1, [], 1), (-2, [None] * width, 2), (-3, [float("nan")] + [0.0] * (width - 1), 2), (-4, [float("inf")] * width, 2), (901, [0.5] * (width + 1), 3)]
    got, want = coded(spark, rows), codes_by_loop(rows)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_codes_of_large_numbers_few_rows_and_none(spark):
    rows = [(1, [float(np.float32(1e30)), 5.0, -1e9, 0.0], 1), (2, [1.0, 5.0, 1e9, 0.0], 1), (3, [2.0, -3.5, float(np.float32(3e38)), 1e-30], 2), (4, [2.0, -3.5, 0.25, -1e-30], 2)]
    got = coded(spark, rows, parts=2, entries=2)
    assert sorted(got) == sorted(codes_by_loop(rows, 2, 2)) and len(got) == 4 and max(r[2] for r in got) == vector_codes.TOP
    assert coded(spark, []) == [] and coded(spark, [(1, None, 2), (2, [], 2), (None, [1.0], 2)]) == []


# --- alignment


def aligned_by_loop(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    names = {i: x for x, i in json.load(open(A))["model"]["vocab"].items()}
    byte = {c: i for i, c in enumerate(packing.byte_letters())}
    docs, counts = [], Counter()
    for text in texts:
        docs.append(None)
        if not text:
            continue
        whole = (" " + text).encode()
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts = [bytes(byte[c] for c in names[i]) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if any(b"".join(x) != whole for x in parts):
            continue
        ends = [np.cumsum([len(x) for x in y]).tolist() for y in parts]
        links, i, j = [], 0, 0
        while i < len(ids[0]):
            links.append((ids[0][i], ids[1][j]))
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
        groups, i, j = [], 0, 0
        for end in sorted({*ends[0]} & {*ends[1]}):
            x, y = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append(",".join(map(str, ids[0][i:x])) + "|" + ",".join(map(str, ids[1][j:y])))
            i, j = x, y
        counts.update(links)
        docs[-1] = len(ids[0]), len(ids[1]), links, ";".join(groups)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(0,) * 6 + ("", "") if d is None else (d[0], d[1], d[3].count(";") + 1, len(d[2]), sum(counts[x] == best[x[1]] for x in d[2]), sum(counts[x] for x in d[2]), hashlib.sha256(d[3].encode()).hexdigest(), d[3]) for d in docs]


ODD = ["", " ", "  ", "a", " a", "a ", "x  y", "\n", "a\n b", "  　 z", "w  q   r", "a  b", "▁", "a ▁b c", "no mark here", "<s> </s> <0x41> <|endoftext|> <unk>", "<|endoftext|>", "tab\t tab \x0b v", "don't can't 12345 1 2", "\U0001f600 \U0001f468‍\U0001f469 é", "\x00 \x1c b \x1f", "日本 語 テスト。 です", "русский текст и ещё", "x" * 5000, " " * 3000 + "y", "a " * 50 + " " * 40, "\r\n \r\n q", "é à ü ñ"]


def test_align(spark, messy, messy_rows):
    texts = [t for _, t in messy_rows] + ODD
    df = messy.select("doc_id", "text", "k").union(spark.createDataFrame([(10**6 + i, t, "k") for i, t in enumerate(ODD)], "doc_id long, text string, k string"))
    want = Counter(zip([i for i, _ in messy_rows] + [10**6 + i for i in range(len(ODD))], aligned_by_loop(texts)))
    for size in (alignment.BATCH_CHARS, 3000):
        got = alignment.align(df.repartition(3), A, B, carry_groups=True, batch_chars=size).collect()
        assert Counter((r[0], (*r[1:7], r[7], r[8])) for r in got) == want


def test_align_units_equal_whole_texts(sf_texts):
    both = alignment.sides(A, B)
    texts = sf_texts + ODD
    ids, counts = both.tokens(texts)
    assert both.apart
    at = [0, 0]
    for i, t in enumerate(texts):
        own = [x[p : p + c[i]].tolist() for x, p, c in zip(ids, at, counts)]
        at = [p + c[i] for p, c in zip(at, counts)]
        if t and "▁" not in t:
            assert own == [both.a(" " + t).tolist(), both.model.encode(t)]
        else:
            assert own == [[], []]


def test_merge_path():
    rng = random.Random(8)
    for step in (1, 2, 3, 7, 100):
        for _ in range(40):
            top = rng.randint(1, 60)
            a, b = (np.array(sorted({*rng.sample(range(1, top + 1), rng.randint(0, top)), top})) for _ in "ab")
            i, j = alignment.divide(a, b, step)
            order = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
            assert [(sum(k == 0 for _, k in order[:d]), sum(k for _, k in order[:d])) for d in [*range(0, len(order), step), len(order)]] == list(zip(i.tolist(), j.tolist()))
            link_a, link_b, cut_a, cut_b = alignment.merged(a, b, step)
            begin = lambda x, k: x[k - 1] if k else 0
            assert list(zip(link_a.tolist(), link_b.tolist())) == [(x, y) for x in range(len(a)) for y in range(len(b)) if max(begin(a, x), begin(b, y)) < min(a[x], b[y])]
            common = sorted({*a.tolist()} & {*b.tolist()})
            assert list(zip(cut_a.tolist(), cut_b.tolist())) == [(int((a <= c).sum()), int((b <= c).sum())) for c in common]


def test_align_of_nothing(spark, empty):
    assert alignment.align(empty, A, B).collect() == []
    one = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert sorted(tuple(r)[1:] for r in alignment.align(one, A, B).collect()) == [(0,) * 6 + ("", None)] * 2


# --- white space that is too long for a pattern


@pytest.mark.parametrize("text", [" " * 2_000_000, "\t" * 2_000_000, "\n" * 2_000_000 + "word", "　" * 2_000_000, "a" + " " * 2_000_000 + "b <|endoftext|>"], ids=["spaces", "tabs", "lines", "wide", "between"])
def test_long_white_space(text):
    from tokenizers import Tokenizer

    for special in (True, False):
        library = Tokenizer.from_file(A)
        library.encode_special_tokens = not special
        assert packing.encoder(A, special=special)(text).tolist() == library.encode(text, add_special_tokens=False).ids
