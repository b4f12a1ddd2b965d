"""Quality rules as learned decision lists.

Sequential covering: a rule for bad documents grows by the threshold test
that gains most on two thirds of the labelled statistics, is pruned on the
other third and kept if it is precise there; what it covers is taken away and
the next rule is learned. The list becomes one conditional expression, so
Spark applies it to every document without Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm import measures as M
from tracewell.llm import words as W

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_shouts", "n_points", "n_short_words"]
MEASURES = "row long, " + ", ".join(f"{c} long" for c in COUNTS)
#: What rules may test, as SQL over the counts.
RATIOS = {
    "n_words": "double(n_words)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "shouts_per_word": "n_shouts / greatest(n_words, 1)",
    "points_per_word": "n_points / greatest(n_words, 1)",
    "short_share": "n_short_words / greatest(n_words, 1)",
}
#: Labelled rows from which rules are learned, at most; chosen by a hash of the id.
MAX_LABELLED = 20_000


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in W.scan(batch.column(1)):
            hashed = W.span_hashes(chunk.data, chunk.starts, chunk.ends)
            word = M.within_words(chunk)
            a, b = chunk.edges[:-1], chunk.edges[1:]
            start, end, first_line = M.line_spans(chunk)
            row = np.repeat(np.arange(chunk.rows), np.diff(first_line))
            written = np.searchsorted(chunk.starts, end) > np.searchsorted(chunk.starts, start)
            later, _ = M.again(W.span_hashes(chunk.data, start, end)[written], row[written])
            letters = M.Counter(chunk, M.CODE_POINTS, word)
            count = lambda table: M.Counter(chunk, table).between(a, b)
            columns = [
                chunk.counts, letters.between(a, b), count(M.SYMBOLS), np.bincount(row[written][later], minlength=chunk.rows), M.per_group(M.repeated_words(chunk, hashed), chunk.first),
                np.bincount(row[written], minlength=chunk.rows), count(M.UPPER), count(M.DIGITS), count(M.SHOUTS), count(M.POINTS), M.per_group(letters.between(chunk.starts, chunk.ends) <= 3, chunk.first),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.row, chunk.rows), *(pa.array(c, pa.int64()) for c in columns)], names=["row", *COUNTS])


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS...) for each row of ``docs`` (doc_id, text), over the whole text; null texts have none of anything."""
    docs = docs.select(F.col("doc_id").cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_measure, MEASURES).withColumnRenamed("row", "doc_id")


@dataclass(frozen=True)
class Test:
    """One threshold test of a rule."""

    name: str
    above: bool
    limit: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.name] >= self.limit if self.above else values[self.name] < self.limit

    def column(self) -> Column:
        value = F.expr(RATIOS[self.name])
        return value >= F.lit(self.limit) if self.above else value < F.lit(self.limit)


Rule = tuple[Test, ...]


def covers(rule: Rule, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for test in rule:
        out &= test.holds(values)
    return out


def grow(values: dict[str, np.ndarray], bad: np.ndarray, most_tests: int = 4) -> Rule:
    """Adds the test with the largest information gain until no good row is covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < most_tests and inside.any() and not bad[inside].all():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        best, best_gain = None, 1e-9
        for name in sorted(values):
            own = values[name][inside]
            order = np.argsort(own, kind="stable")
            x, y = own[order], bad[inside][order]
            cuts = np.flatnonzero(x[1:] > x[:-1]) + 1
            if not len(cuts):
                continue
            below = np.cumsum(y)[cuts - 1]
            for above in (True, False):
                tp = (p - below) if above else below
                size = (len(y) - cuts) if above else cuts
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(tp > 0, tp * (np.log2(tp / size) - np.log2(p / (p + n))), -1)
                at = int(np.argmax(gain))
                if gain[at] > best_gain:
                    best, best_gain = Test(name, above, float((x[cuts[at]] + x[cuts[at] - 1]) / 2)), gain[at]
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(values)
    return rule


def prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The prefix of the rule that is worth most on other rows: (bad - good) / covered."""

    def worth(r: Rule) -> float:
        inside = covers(r, values, len(bad))
        return float((2 * bad[inside].sum() - inside.sum()) / max(1, inside.sum()))

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn(values: dict[str, np.ndarray], bad: np.ndarray, precise: float = 0.9, most_rules: int = 12) -> list[Rule]:
    """An ordered list of rules for bad rows. Every third row prunes, the others grow."""
    rules: list[Rule] = []
    prunes = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules and bad[left].sum() >= 5:
        part = lambda rows: {k: v[rows] for k, v in values.items()}
        g, p = left & ~prunes, left & prunes
        rule = prune(grow(part(g), bad[g]), part(p), bad[p])
        inside = covers(rule, values, len(bad)) & left
        judged = bad[inside & prunes]
        if not rule or not len(judged) or judged.mean() < precise or bad[inside].mean() < precise:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: false for what a rule covers, else true."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for t in rule[1:]:
            test &= t.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[Rule]:
    """Rules from at most ``most`` labelled ids; only their counts come to the driver.

    An id with labels of both kinds, a null id and a quality other than 0 and
    1 teach nothing; repeated labels count once. Of rows that repeat an id,
    the one with the smallest counts teaches. Null and empty texts have counts
    of 0. Without labels or documents there are no rules.
    """
    labels = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").drop("other")
    labels = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = measures(docs.join(F.broadcast(labels.select("doc_id")), "doc_id", "left_semi")).groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("counts")).select("doc_id", "counts.*")
    data = rows.join(F.broadcast(labels), "doc_id").select(F.xxhash64("doc_id").alias("place"), "doc_id", *(F.expr(x).alias(k) for k, x in RATIOS.items()), "quality").toPandas()
    data = data.sort_values(["place", "doc_id"])  # at most as many rows as labels
    return learn({k: data[k].to_numpy(float) for k in RATIOS}, data["quality"].to_numpy() == 0)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, counts, base_failed, kept) for each row of ``docs`` (doc_id, text).

    base_failed: fewer than 50 words, or over half of the words in repeated
    3-word windows. Null and empty texts have no words and fail. Rows are
    judged one by one: repeated rows and null ids stay as they are.
    """
    out = measures(docs).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))
