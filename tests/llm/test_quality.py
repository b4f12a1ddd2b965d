"""Quality rules and the line classifier."""

import re
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import line_crf, quality_rules


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {p for s in range(len(w) - 2) if c[tuple(w[s : s + 3])] > 1 for p in (s, s + 1, s + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(cover)


def test_measures(messy, messy_rows, empty):
    got = sorted(map(repr, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.measures(messy).collect())))
    assert got == sorted(repr((i, *base(t))) for i, t in messy_rows)
    assert quality_rules.measures(empty).collect() == []


def test_rules_find_the_planted_ones():
    rng = np.random.default_rng(0)
    n = 1500
    values = {k: rng.random(n) for k in quality_rules.RATIOS}
    bad = ((values["symbols_per_word"] > 0.8) & (values["dup_line_share"] < 0.5)) | (values["upper_share"] > 0.95)
    rules = quality_rules.learn(values, bad)
    said = np.zeros(n, bool)
    for rule in rules:
        said |= quality_rules.covers(rule, values, n)
    assert (said == bad).mean() > 0.97 and rules == quality_rules.learn(values, bad)


def test_verdict_is_the_list(spark, messy):
    rules = [(quality_rules.Test("symbols_per_word", True, 0.5),), (quality_rules.Test("n_words", False, 60.0), quality_rules.Test("dup_line_share", False, 0.1))]
    for r in quality_rules.judge(messy, rules).collect():
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        covered = r.n_symbols / max(r.n_words, 1) >= 0.5 or (r.n_words < 60 and r.n_dup_lines / max(r.n_lines, 1) < 0.1)
        assert r.base_failed == failed and r.kept == (not failed and not covered)


def test_rules_without_labels(messy, messy_rows, spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.fit(messy, none) == [] and quality_rules.judge(messy, []).count() == len(messy_rows)
    assert quality_rules.judge(empty, []).collect() == []


def lines_by_loop(crf, x):
    """Marginals of one chain by summing over all labellings."""
    t = crf.pair.reshape(2, 2)
    total, good = 0.0, np.zeros(len(x))
    for code in range(2 ** len(x)):
        y = [(code >> k) & 1 for k in range(len(x))]
        s = np.exp(sum(x[k] @ crf.weight * y[k] for k in range(len(x))) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += s
        good += s * np.array(y)
    return good / total


def test_forward_backward():
    rng = np.random.default_rng(1)
    crf = line_crf.Crf(rng.normal(size=3), rng.normal(size=4))
    sizes = [1, 5, 0, 3, 7]
    first = np.concatenate([[0], np.cumsum(sizes)])
    x = rng.normal(size=(first[-1], 3))
    p = crf.marginals(line_crf.Lines(x, np.ones(len(x)), first))
    for a, b in zip(first, first[1:], strict=False):
        assert p[a:b] == pytest.approx(lines_by_loop(crf, x[a:b]))


def test_training_follows_the_labels():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 8, 300)
    first = np.concatenate([[0], np.cumsum(sizes)])
    doc = rng.integers(0, 2, 300)
    good = np.repeat(doc, sizes)
    x = rng.normal(size=(len(good), 23)) * 0.5
    x[:, 2] += good * 2
    x[:, line_crf.BIAS] = 1
    lines = line_crf.Lines(x, np.ones(len(x)), first)
    p = line_crf.train(lines, good).marginals(lines)
    assert ((p > 0.5) == good).mean() > 0.95


def test_classifier_on_held_out_documents(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    out = line_crf.score(docs, line_crf.fit(docs, labels)).selectExpr("row.doc_id AS doc_id", "predicted", "score").join(labels, "doc_id").filter("crc32(cast(doc_id AS string)) % 5 = 0").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95 and all(0 <= r.score <= 1 for r in out)


def test_scores_of_messy_rows(spark, messy, messy_rows, empty):
    crf = line_crf.fit(messy, spark.createDataFrame([(3, 1), (6, 0), (None, 1), (9, None)], "doc_id long, quality int"))
    out = line_crf.score(messy, crf).collect()
    assert len(out) == len(messy_rows) and all(r.score == 0 for r in out if not (r.row.text or "").split())
    assert line_crf.score(empty, crf).collect() == []
    none = line_crf.fit(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r.score == 0.5 for r in line_crf.score(messy, none).collect() if (r.row.text or "").encode().split())
