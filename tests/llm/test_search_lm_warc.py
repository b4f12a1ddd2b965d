"""Search, language-model scores, archives and the pipeline."""

import base64
import hashlib
import io
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewell.llm import bm25, interpolation, warc


def words(text):
    return (text or "").encode().lower().split()


def bm25_by_loop(rows, queries, k):
    docs = [(i, Counter(words(t))) for i, t in rows if i is not None]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(w for _, c in docs for w in c)
    out = {}
    for q, text in queries:
        found = []
        for i, c in docs:
            length, s = sum(c.values()), 0.0
            for w, times in Counter(words(text)).items():
                if c[w]:
                    s += times * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / mean))
            if s > 0:
                found.append((-round(s, 9), i))
        out[q] = sorted(found)[:k]
    return out


def test_search(spark, messy, messy_rows, monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK", 4)
    queries = [(1, "w1 w2 w3 w3"), (2, messy_rows[0][1] or "w5"), (3, "nowhere"), (4, None), (5, "ONE w7. w8")]
    df = spark.createDataFrame(queries, "query_id long, text string")
    got = defaultdict(list)
    for r in bm25.search(bm25.build(messy), df, 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-round(r.score, 9), r.doc_id))
    want = bm25_by_loop(messy_rows, queries, 7)
    assert {q: [round(s, 6) for s, _ in v] for q, v in want.items() if v} == {q: [round(s, 6) for s, _ in v] for q, v in got.items()}
    assert {q: v for q, v in want.items() if v}.keys() == got.keys()
    for q, v in got.items():
        cut = v[-1][0]
        assert {x for x in v if x[0] < cut - 1e-6} == {x for x in want[q] if x[0] < cut - 1e-6}


def test_wand_equals_all_scores():
    rng = np.random.default_rng(4)
    for _ in range(60):
        cursors, total = [], defaultdict(float)
        for term in range(rng.integers(1, 6)):
            docs = np.sort(rng.choice(300, rng.integers(1, 200), replace=False))
            scores = rng.random(len(docs)) * rng.choice([0.1, 1, 3])
            bounds = np.array([scores[a : a + bm25.BLOCK].max() for a in range(0, len(scores), bm25.BLOCK)])
            cursors.append(bm25.Cursor(term, 1.0, docs, scores, bounds))
            for d, s in zip(docs.tolist(), scores.tolist(), strict=True):
                total[d] += s
        want = sorted(((s, d) for d, s in total.items()), key=lambda x: (-x[0], x[1]))[:10]
        got = bm25.wand(cursors, 10)
        assert [d for _, d in got] == [d for _, d in want] and [s for s, _ in got] == pytest.approx([s for s, _ in want])


def test_whole_texts_in_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, rng.integers(1, 150)))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    queries = docs.filter("doc_id % 20 = 0").selectExpr("doc_id as query_id", "text")
    index = bm25.build(docs)
    monkeypatch.setattr(bm25, "BLOCK_TERMS", 100)
    got = defaultdict(list)
    for r in bm25.search(index, queries).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-round(r.score, 6), r.doc_id))
    want = bm25_by_loop(rows, [r for r in rows if r[0] % 20 == 0], 10)
    assert got == {q: [(round(s, 6), d) for s, d in v] for q, v in want.items()} and len(got) == 12


def test_queries_share_the_postings_of_a_term():
    docs, scores, bounds = [1, 5, 9], [0.5, 1.0, 0.25], [1.0]
    one, two = bm25.Cursor(3, 2.0, docs, scores, bounds), bm25.Cursor(3, 1.0, docs, scores, bounds)
    assert one.docs is two.docs and one.scores is two.scores and one.bounds is two.bounds
    assert bm25.wand([one], 2) == [(2.0, 5), (1.0, 1)] and bm25.wand([two], 1) == [(1.0, 5)]


def test_search_of_nothing(spark, empty, messy):
    q = spark.createDataFrame([(1, "w1")], "query_id long, text string")
    assert bm25.search(bm25.build(empty), q).collect() == []
    assert bm25.search(bm25.build(messy), q.limit(0)).collect() == []


def test_scores(spark, messy, messy_rows, monkeypatch):
    monkeypatch.setattr(interpolation, "BATCH_TOKENS", 2000)
    role = lambda i: 0 if i is None else {1: 2, 2: 1}.get(zlib.crc32(str(i).encode()) % 5, 0)
    tokens = [(i, [*words(t), "END"]) for i, t in messy_rows]
    count = lambda roles: (Counter(w for i, x in tokens if role(i) in roles for w in x), Counter(p for i, x in tokens if role(i) in roles for p in zip(["START", *x], x, strict=False)))
    (uni, bi), (uni_m, bi_m) = count({0, 1}), count({0})
    train, distinct, main = sum(uni.values()), len(uni), sum(uni_m.values())
    uniform = 1 / (distinct + 1)

    def parts(u, b, start, total, h, w):
        c = start if h == "START" else u[h]
        return interpolation.bucket_of(np.array([c]))[0], b[h, w] / max(c, 1), u[w] / max(total, 1)

    cell = Counter()
    start_m, start = sum(1 for i, _ in tokens if role(i) == 0), sum(1 for i, _ in tokens if role(i) < 2)
    for i, x in tokens:
        if role(i) == 1:
            for h, w in zip(["START", *x], x, strict=False):
                b, p2, p1 = parts(uni_m, bi_m, start_m, main, h, w)
                cell[int(b), p2, p1] += 1
    rows = [(*k, n) for k, n in sorted(cell.items())]
    weights = interpolation.learn_weights(spark.createDataFrame(rows, interpolation.CELLS), uniform)
    ours = best = 0.0
    for b in {r[0] for r in rows}:  # the unrounded likelihood, by many rounds of plain EM
        p, n = np.array([(p2, p1, uniform) for c, p2, p1, _ in rows if c == b]), np.array([r[3] for r in rows if r[0] == b])
        w = np.array([0.3, 0.5, 0.2])
        for _ in range(3000):
            share = p * w
            w = (share / share.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
        ours, best = ours + n @ np.log(p @ weights[b]), best + n @ np.log(p @ w)
    assert best - 1e-3 * sum(cell.values()) <= ours <= best + 1e-6 * sum(cell.values())
    want = []
    for i, x in tokens:
        base = score = 0.0
        for h, w in zip(["START", *x], x, strict=False):
            b, p2, p1 = parts(uni, bi, start, train, h, w)
            score += math.log10(weights[b] @ [p2, p1, uniform])
            base += math.log10((uni[w] + 0.5) / (train + 0.5 * (distinct + 1)))
        want.append((repr(i), role(i) == 2, len(x), sum(uni[w] > 0 for w in x), train, round(base, 6), round(score, 6)))
    got = [(repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in interpolation.score(messy).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-4)


def test_weights_are_the_likeliest(spark):
    rng = np.random.default_rng(0)
    cell = [(3, float(2.0 ** -rng.uniform(0, 10)), float(2.0 ** -rng.uniform(5, 15)), int(rng.integers(1, 50))) for _ in range(40)]
    weights = interpolation.learn_weights(spark.createDataFrame(cell, interpolation.CELLS), 1e-6)
    p, n = np.array([(a, b, 1e-6) for _, a, b, _ in cell]), np.array([c[3] for c in cell])
    value = lambda x: (n * np.log(p @ x)).sum()
    for other in rng.dirichlet([1, 1, 1], 200):
        assert value(weights[3]) >= value(other) - 1e-3 * n.sum()
    assert (weights[4:] == weights[3]).all() and np.allclose(weights.sum(axis=1), 1)


def test_sorted_values_travel_by_their_differences():
    x = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    for own in (x, x[:1], x[:0], np.array([0, 0, 2**64 - 1], np.uint64)):
        assert (interpolation.expand_sorted(interpolation.squeeze_sorted(own), len(own)) == own).all()


def test_score_of_nothing(empty):
    assert interpolation.score(empty).collect() == []


PAGES = [(1, "http://a/ü\r\nx", "<p>é</p>" * 50), (2, None, "<p>é</p>" * 50), (5, "http://b", None), (6, "http://c", ""), (7, "u", "x" * 70_000), (9, "u", "<p>é</p>" * 50), (9, "u", "<p>é</p>" * 50), (None, "n", "lone"), (None, "n", "lone"), (None, "n", "x" * 70_000)]


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 50_000)
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, archive string").repartition(2)
    folder, archives = warc.write(pages)
    assert archives.count() > 1
    got = sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in warc.read(folder, archives).collect())
    want, source = [], {}
    for i, _, h in PAGES:
        source[h or ""] = max((x for x in (source.get(h or ""), i) if x is not None), default=None)
    for i, _, h in PAGES:
        body, s = (h or "").encode(), source[h or ""]
        revisit = s is not None and s != i
        want.append(repr((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", s if revisit else None)))
    assert got == sorted(want)
    few = warc.read(*warc.write(pages, min_bytes=1000))
    assert few.filter("record_type = 'revisit'").count() == 1


def test_archives_of_nothing(spark):
    folder, archives = warc.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read(folder, archives).collect() == []


def one_archive(tmp_path):
    w = warc.Writer(str(tmp_path), "t", warc.train_dictionary([b"<html>%d</html>" % i * 20 for i in range(50)]))
    for i in range(5):
        w.add(warc.record(i, "u", b"<html>%d</html>" % i * 99, False, None))
    name = w.close()[0]
    return (tmp_path / name).read_bytes()


def test_damage_is_found(tmp_path):
    data = one_archive(tmp_path)
    assert len(list(warc.frames(io.BytesIO(data), "x"))) == 5
    with pytest.raises(ValueError, match="cut off"):
        list(warc.frames(io.BytesIO(data[:-3]), "x"))
    with pytest.raises(ValueError, match="no dictionary"):
        list(warc.frames(io.BytesIO(b"XXXX" + data[4:]), "x"))
    good = warc.record(1, "u", b"payload", False, None)
    for bad, said in ((good.replace(b"payload", b"paylode"), "digest"), (good.replace(b"Content-Length: 7", b"Content-Length: 8"), "Content-Length"), (good.replace(b"WARC/1.1", b"WARC/0.9"), "no WARC"), (good.replace(b"WARC-Date", b"WARC-Type"), "bad header")):
        with pytest.raises(ValueError, match=said):
            warc.parse(bad, "x")
    assert warc.parse(good, "x")[1] == b"payload"


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["quality_classifier", "line_dedup", "near_duplicates", "substring_dedup", "packing"]
    docs = first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = []
    for _, stage in C.STAGES[:-1]:
        docs = C.save(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == first.columns and docs.filter("n_chars <> length(text)").count() == 0
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    out = C.STAGES[-1][1](spark, docs, sf_dir)
    assert out.select("doc_id").distinct().count() == sizes[-1]


def test_registered(spark):
    import __spark_entry__ as e

    names = {n.split("_")[0] for n in e.queries()}
    assert {f"op{i}" for i in range(1, 11)} <= names and "pipeline" in e.queries()
