"""Near duplicates, repeated windows and lines against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import line_dedup, ngram_join, substring_dedup

LAST = 2**63 - 1


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    """Smallest id reachable; rows of one id are one node."""
    up = {i: i for i, _ in rows if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for a, (i, s) in enumerate(sets):
        for j, r in sets[:a]:
            if s and r and 100 * len(s & r) >= 80 * len(s | r):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: top(i) for i in up}


def test_near_duplicates(messy, messy_rows):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in ngram_join.near_duplicates(messy).collect())
    comp = components(messy_rows)
    by_set = {shingles(t): comp[i] for i, t in messy_rows if i is not None and shingles(t)}
    want = []
    for i, t in messy_rows:
        s = shingles(t)
        c = by_set.get(s, i) if s else i
        want.append((i if i is not None else -1, len(s), c if c is not None else -1))
    assert got == sorted(want)
    assert len({c for _, n, c in got if n}) < len(messy_rows) - 25


def test_the_share_of_the_first_filter_changes_nothing(messy):
    key = lambda share: sorted(map(repr, ngram_join.near_duplicates(messy, share=share).collect()))
    assert key(1.0) == key(0.3)


def test_near_duplicates_of_nothing(empty):
    assert ngram_join.near_duplicates(empty).collect() == []


def documents(rows):
    """Distinct rows as documents in order: ids, nulls last; of one id, any order that is fixed."""
    return sorted(set(rows), key=lambda r: (LAST if r[0] is None else r[0]))


def windows_removed(rows, order):
    first, out = {}, {}
    for d, (i, t) in enumerate(order):
        w = (t or "").encode().split()
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (d, s))
    for d, (i, t) in enumerate(order):
        w, gone = (t or "").encode().split(), set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] != (d, s):
                gone.update(range(s, s + 20))
        out[i, t] = (len(w), len(gone), b" ".join(x for n, x in enumerate(w) if n not in gone).decode())
    return out


def test_repeated_windows(spark, messy, messy_rows):
    got = defaultdict(list)
    for r in substring_dedup.remove_repeats(messy).collect():
        assert r.row.score == "s"
        got[r.row.doc_id, r.row.text].append((r.n_words, r.n_removed, r.kept))
    assert sum(map(len, got.values())) == len(messy_rows)
    prints = {t: p for t, p in spark.createDataFrame([(t,) for _, t in messy_rows], "t string").selectExpr("t", "xxhash64(t)").collect()}
    order = sorted(set(messy_rows), key=lambda r: (LAST if r[0] is None else r[0], prints[r[1]]))
    want = windows_removed(messy_rows, order)
    assert {k: v for k, vs in got.items() for v in vs} == want and all(len(set(v)) == 1 for v in got.values())
    assert sum(n for _, n, _ in want.values()) > 1000


def test_repeats_in_one_text_and_hash_ties(spark):
    w = " ".join(f"a{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"{w} {w} x {w}"), (2, w), (3, " ".join(["z"] * 45))], "doc_id long, text string")
    got = {r.row.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {1: (61, 40), 2: (20, 20), 3: (45, 44)}


def test_a_shared_header_is_dealt_by_windows(spark, monkeypatch):
    """The windows across the edge of a header that most texts share have its minimisers, but differ."""
    import random

    rng = random.Random(9)
    header, tail = (" ".join(f"{x}{i}" for i in range(25)) for x in "hm")
    rows = [(i, f"{header} {' '.join(f'w{rng.randint(0, 40)}' for _ in range(30))} {tail}") for i in range(300)]
    rows += [(1000 + i, f"x{i} {rows[i][1]}") for i in range(0, 300, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {i: v for (i, _), v in windows_removed(rows, rows).items()}
    sizes = {}
    for hot in (10**9, 50):
        monkeypatch.setattr(substring_dedup, "HOT_WINDOWS", hot)
        monkeypatch.setattr(substring_dedup, "HOT_SHARE", 2)
        got = {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs).collect()}
        assert got == want
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([0] * len(rows)), pa.array([r[1] for r in rows])], names=["k", "fp", "text"])
    for hot, extra in ([], 1), (list(range(8)), 16):
        for block in substring_dedup.super_kmers(20, 3, 8, hot, extra)(iter([batch])):
            for bucket, n, words in zip(*(block.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if words is not None:
                    assert (bucket >= 8) == bool(hot)
                    sizes[len(hot), bucket] = sizes.get((len(hot), bucket), 0) + n
    assert len([b for h, b in sizes if h]) == 16 and max(n for (h, _), n in sizes.items() if h) < 3 * sum(n for (h, _), n in sizes.items() if h) / 16


def test_windows_of_nothing(empty):
    assert substring_dedup.remove_repeats(empty).collect() == [] and line_dedup.remove_lines(empty).collect() == []


def lines_of(text):
    return [] if text is None else text.split("\n")


def lines_removed(order, min_words=8):
    """Lines of each text in a block of consecutive lines, of min_words or more, that any earlier text has; by comparing every pair."""
    sets = [[x.strip(" \t\x0b\x0c\r") for x in lines_of(t)] for _, t in order]
    sizes = [[len(x.encode().split()) for x in own] for own in sets]
    gone = defaultdict(set)
    for d, late in enumerate(sets):
        for early in sets[:d]:
            if not set(early) & set(late) - {""}:
                continue
            before = [0] * (len(early) + 1)
            for j, x in enumerate(late):
                row = [0] * (len(early) + 1)
                for i, y in enumerate(early):
                    if x == y:
                        row[i + 1] = before[i] + 1
                before, longest = row, max(row)
                if sum(sizes[d][j + 1 - longest : j + 1]) >= min_words:
                    gone[d].update(range(j + 1 - longest, j + 1))
    return gone


def lines_aligned(rows, min_words=8):
    """What alignments delete if every document is aligned with all earlier ones."""
    sets = [[x.strip(" \t\x0b\x0c\r") for x in lines_of(t)] for _, t in rows]
    sizes = [[len(x.encode().split()) for x in own] for own in sets]
    number = {"": 0}
    arrays = [np.array([number.setdefault(x, len(number)) for x in s], np.int64) for s in sets]
    gone = defaultdict(set)
    for d, late in enumerate(arrays):
        for early in arrays[:d]:
            gone[d].update(line_dedup.deleted(early, late, np.array(sizes[d]), min_words).tolist())
    return gone


def test_lines(spark, messy, messy_rows):
    prints = {t: p for t, p in spark.createDataFrame([(t,) for _, t in messy_rows], "t string").selectExpr("t", "xxhash64(t)").collect()}
    order = sorted(set(messy_rows), key=lambda r: (LAST if r[0] is None else r[0], prints[r[1]]))
    gone = lines_removed(order)
    got = {(r.row.doc_id, r.row.text): (r.n_lines, r.n_removed, r.kept) for r in line_dedup.remove_lines(messy).collect()}
    total = 0
    for d, (i, t) in enumerate(order):
        all_ = lines_of(t)
        kept = t if not gone[d] else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d])
        assert got[i, t] == (len(all_), len(gone[d]), kept)
        total += len(gone[d])
    assert total > 20 and line_dedup.remove_lines(messy).count() == len(messy_rows)


@pytest.mark.parametrize("hot", [15, 1000])
def test_blocks_of_frequent_lines_whose_first_holders_differ(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_DF", hot)
    a, b, c = "one two three four", "five six seven eight", "nine ten eleven twelve"
    long = [" ".join(f"{x}{n}" for n in range(9)) for x in "xy"]
    rows = [(1, a), (2, b), (3, f"own words here now\n{c}"), (4, f"{b}\nmore\n{a}"), (5, "\n".join(long))]
    rows += [(i, f"top {i}\n{a}\n\n{b}\n{c}\nend {i}") for i in range(10, 30)]
    rows += [(i, f"top {i}\n{a}\n{b}\nend {i}\n{c}") for i in range(30, 50)]
    rows += [(i, f"top {i}\n{long[1]}\n{long[0]}\nend {i}") for i in range(50, 70)]
    rows += [(i, f"top {i}\n{c}\n{b}\nmid {i}\n{b}\n{c}\n{b}\n{c}") for i in range(70, 90)]
    gone = lines_removed(rows)
    got = {r.row.doc_id: r.n_removed for r in line_dedup.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: len(gone[d]) for d, (i, _) in enumerate(rows)}
    assert [got[i] for i in (10, 11, 29, 30, 31, 51, 71)] == [0, 4, 4, 0, 2, 2, 6]


@pytest.mark.parametrize("seed", range(4))
def test_random_lines_against_every_pair(spark, seed):
    """Few different lines, blank ones among them, in every order: moved and repeated blocks of rare and frequent lines, which alignments partly miss."""
    import random

    rng = random.Random(seed)
    lines = ["", " "] + [" ".join(f"v{n}x{k}" for k in range(rng.randint(1, 5))) for n in range(12)]
    passages = [[rng.choice(lines) for _ in range(rng.randint(2, 9))] for _ in range(8)]
    rows = []
    for i in range(70):
        own = [rng.choice(lines) if rng.random() < 0.4 else f"only {i} {n}" for n in range(rng.randint(0, 8))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(own))
            own[at:at] = rng.choice(passages)
        rows.append((i, "\n".join(own)))
    blocks, aligned = lines_removed(rows), lines_aligned(rows)
    got = {r.row.doc_id: (r.n_removed, r.kept) for r in line_dedup.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = 0
    for d, (i, t) in enumerate(rows):
        assert aligned[d] <= blocks[d] and got[i][0] <= len(aligned[d])
        if got[i][0] == len(aligned[d]):
            assert got[i][1] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in aligned[d])
        found += got[i][0]
    recall = found / sum(map(len, aligned.values())), found / sum(map(len, blocks.values()))
    print(f"recall of what aligning every pair deletes: {recall[0]:.3f}; of all lines in common blocks: {recall[1]:.3f}")
    assert recall[0] > 0.9


def test_given_documents_against_every_pair(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    gone = lines_removed(rows)
    got = {r.row.doc_id: r.n_removed for r in line_dedup.remove_lines(docs).collect()}
    assert got == {i: len(gone[d]) for d, (i, _) in enumerate(rows)}


def test_a_text_of_very_many_lines(spark):
    import time

    text = "\n".join(f"line {n % 60_000} of many" for n in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, "x\n" + text)], "doc_id long, text string")
    began = time.time()
    got = {r.row.doc_id: (r.n_removed, r.kept) for r in line_dedup.remove_lines(docs).collect()}
    assert got == {1: (0, text), 2: (200_000, "x")} and time.time() - began < 120


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_patience_is_a_common_subsequence():
    import random

    rng = random.Random(7)
    for _ in range(300):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) <= lcs(a, b)
        assert all(i < p and j < q for (i, j), (p, q) in zip(pairs, pairs[1:], strict=False))
    a = list(range(50))
    b = a[:10] + [99, 98] + a[10:]
    assert len(line_dedup.patience(a, b)) == 50


def test_a_gap_without_unique_lines_is_aligned(monkeypatch):
    import random

    passage = list(range(100, 106))
    early, late = [1, *passage, 2, *passage, 3], [4, *passage, 5]
    assert line_dedup.aligned(early, late, [3] * 8, 8) == [1, 2, 3, 4, 5, 6]
    assert line_dedup.aligned(late, early, [3] * 15, 8) in ([1, 2, 3, 4, 5, 6], [8, 9, 10, 11, 12, 13])
    assert line_dedup.deleted(np.array(late), np.array(early), np.full(15, 3), 8).tolist() == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13]
    rng = random.Random(8)
    for bits in (line_dedup.MAX_BITS, 20):
        monkeypatch.setattr(line_dedup, "MAX_BITS", bits)
        for _ in range(300):
            a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 30))] for _ in range(2))
            pairs = line_dedup.common(a, b)
            assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == lcs(a, b)
            assert all(i < p and j < q for (i, j), (p, q) in zip(pairs, pairs[1:], strict=False))


def test_sha_of_kept(messy):
    for r in substring_dedup.remove_repeats(messy, carry=False).selectExpr("row", "kept", "sha2(kept, 256) AS h").limit(5).collect():
        assert r.h == hashlib.sha256(r.kept.encode()).hexdigest() and list(r.row.asDict()) == ["doc_id"]


def test_only_alignments_delete(spark, monkeypatch):
    """A common block that no alignment proposes stays, and without alignment nothing goes."""
    import random

    # r occurs in both as r r r: equal lines at the begin and the end are aligned first, and what is between has no block of 8 words.
    early, late = [1, 5, 6, 1, 9, 2], [5, 6, 1, 5, 2]
    sizes = [4] * 5
    want = {j for x in line_dedup.blocks(line_dedup.patience(early, late), sizes, 8) for j in x}
    assert want <= set(line_dedup.deleted(np.array(early), np.array(late), np.array(sizes), 8).tolist())
    rng = random.Random(3)
    stays = 0
    for _ in range(3000):
        early, late = ([rng.randint(0, 4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        sizes = [3] * len(late)
        gone = set(line_dedup.deleted(np.array(early), np.array(late), np.array(sizes), 8).tolist())
        every = {j + t for i in range(len(early)) for j in range(len(late)) for n in range(3, 13) if i + n <= len(early) and j + n <= len(late) and early[i : i + n] == late[j : j + n] for t in range(n)}
        assert gone <= every
        stays += len(every - gone)
    assert stays > 0
    rows = [(1, "one two three\nfour five six\nseven eight nine"), (2, "x\none two three\nfour five six\nseven eight nine\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.n_removed for r in line_dedup.remove_lines(df).collect()) == [0, 3]


def test_long_gaps_of_repeated_lines():
    import random

    rng = random.Random(4)
    a = [rng.randint(0, 50) for _ in range(100_000)]
    gone = line_dedup.deleted(np.array(a), np.array(a[50_000:] + a[:40_000]), np.full(90_000, 3), 8)
    assert len(gone) > 89_900


def test_a_diff_is_the_same_in_tiles_of_any_size(monkeypatch):
    import random

    rng = random.Random(9)
    cases = [[[rng.randint(0, k) for _ in range(rng.randint(0, 30))] for _ in range(2)] for k in (1, 3, 8) for _ in range(100)]
    whole = [line_dedup.common(a, b) for a, b in cases]
    for bits in (1, 4, 20, 100):
        monkeypatch.setattr(line_dedup, "MAX_BITS", bits)
        assert [line_dedup.common(a, b) for a, b in cases] == whole


def test_a_diff_of_very_many_lines_is_whole():
    import random

    rng = random.Random(1)
    a = [rng.randint(0, 1) for _ in range(90_000)]
    b = [x for x in a if rng.random() < 2 / 3]
    pairs = line_dedup.common(a, b)
    assert len(a) * len(b) > 5e9 and [b[j] for _, j in pairs] == b == [a[i] for i, _ in pairs]


def test_runs_are_joined_as_a_whole():
    early, late = np.array([1, 2, 1, 2, 3, 2, 9, 3, 4]), np.array([1, 2, 3, 8, 3, 4])
    assert line_dedup.joined(early, late, [(0, 0), (5, 1), (7, 4), (8, 5)]) == [(0, 0), (1, 1), (7, 4), (8, 5)]
    assert line_dedup.joined(early, late, [(2, 0), (5, 1), (7, 2), (8, 5)]) == [(2, 0), (3, 1), (4, 2), (8, 5)]
    assert line_dedup.joined(early, late, []) == []


def alternating(n):
    """Two texts whose common part is 2 * n lines or more, of two kinds, so that no line and no run of lines is unique."""
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen sixteen"
    return "\n".join(["start", *[a, b] * n, "end"]), "\n".join(["other start", b, *[a, b] * n, "other end"])


@pytest.mark.parametrize("n", [3, 33_000])
def test_alternating_lines_go_at_any_length(spark, n):
    texts = alternating(n)
    got = {r.row.doc_id: (r.n_removed, r.kept) for r in line_dedup.remove_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (0, texts[0]), 1: (2 * n + 1, "other start\nother end")}
