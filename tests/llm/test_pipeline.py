"""Each stage of the pipeline against brute force, on messy rows and on none."""

import zlib
from array import array
from collections import defaultdict

import corpus_pipeline as C
import pytest
from test_dedup import LAST, alternating, components, lines_removed, shingles, windows_removed
from tracewell.llm import line_crf
from tracewell.llm.queries import tokenizer
from tracewell.llm.store import save

STAGES = dict(C.STAGES)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def in_order(spark, rows):
    prints = {t: p for t, p in spark.createDataFrame([(t,) for _, t in rows], "t string").selectExpr("t", "xxhash64(t)").collect()}
    return sorted(set(rows), key=lambda r: (LAST if r[0] is None else r[0], prints[r[1]]))


@pytest.fixture(scope="module")
def labelled(spark, messy_rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = [(i, int(len(t or "") > 40)) for i, t in messy_rows if i is not None] + [(None, 1), (messy_rows[0][0], None)]
    spark.createDataFrame(rows, "doc_id long, quality int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_stages_on_messy_rows(spark, messy, labelled):
    docs = save(messy, "messy")
    names = docs.columns
    out = save(STAGES["quality_classifier"](spark, docs, labelled), "q")
    crf = line_crf.fit(docs, spark.read.parquet(f"{labelled}/labels.parquet"))
    good = [(r.row.doc_id, r.row.text) for r in line_crf.score(docs, crf).collect() if r.score >= 0.3]
    assert out.columns == names and rows_of(out) == sorted(good, key=repr) and 50 < len(good) < docs.count()

    def changed(stage, docs, texts):
        """The stage's rows are those of ``texts`` that have a word left, with n_chars and other columns as they should be."""
        out = save(STAGES[stage](spark, docs, labelled), stage)
        want = [(i, texts[i, t]) for i, t in rows_of(docs) if (texts[i, t] or "").split()]
        assert out.columns == names and rows_of(out) == sorted(want, key=repr)
        assert {(r.k, r.fp, r.row) for r in out.collect()} == {("k", 1, "row")}
        return out

    order = in_order(spark, rows_of(out))
    gone = lines_removed(order)
    texts = {r: "\n".join(x for n, x in enumerate((r[1] or "").split("\n")) if n not in gone[d]) for d, r in enumerate(order)}
    out = changed("line_dedup", out, texts)
    assert any(gone.values())

    rows = rows_of(out)
    comp = components(rows)
    stay = [(i, t) for i, t in rows if i is None or not shingles(t) or comp[i] == i]
    out = save(STAGES["near_duplicates"](spark, out, labelled), "near")
    assert out.columns == names and rows_of(out) == sorted((r for r in stay if r[0] is None or comp[r[0]] == r[0]), key=repr)

    rows = rows_of(out)
    cut = windows_removed(rows, in_order(spark, rows))
    out = changed("substring_dedup", out, {r: kept if n else r[1] for r, (_, n, kept) in cut.items()})

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want, fill = defaultdict(int), defaultdict(list)
    for i, t in rows_of(out):
        ids = [*whole.encode(t, add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 2048):
            want[i, a, zlib.crc32(array("I", ids[a : a + 2048]).tobytes()), len(ids)] += 1
    for r in STAGES["packing"](spark, out, labelled).collect():
        want[r.doc_id, r.start, r.ids_crc32, r.doc_tokens] -= 1
        fill[r.sequence_id].append((r.offset, r.length))
    assert not any(want.values())
    for places in fill.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(places), sorted(places)[1:], strict=False)) and sum(n for _, n in places) <= 2048 and min(places)[0] == 0


def test_stages_on_nothing(spark, empty, labelled):
    for name, stage in C.STAGES:
        out = stage(spark, save(empty, name), labelled)
        assert out.collect() == [] and (name == "packing" or out.columns == empty.columns)


@pytest.mark.parametrize("n", [3, 33_000])
def test_line_dedup_has_one_rule_for_any_length(spark, labelled, n):
    early, late = alternating(n)
    docs = spark.createDataFrame([(1, early, len(early)), (2, late, len(late))], "doc_id long, text string, n_chars long")
    got = sorted(tuple(r) for r in STAGES["line_dedup"](spark, docs, labelled).collect())
    assert got == [(1, early, len(early)), (2, "other start\nother end", 21)]
