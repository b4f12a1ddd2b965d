"""The registered queries of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import alignment, bm25, interpolation, line_crf, line_dedup, mixing, ngram_join, packing, pieces, quality_rules, substring_dedup, vector_codes, warc


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is; every executor has these files."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str, rows: int = 1024) -> DataFrame:
    """A given table; Arrow batches have few rows, as these hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("piece_bpe_32k.model")
    out = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "n_ids", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), F.expr("decoded = coalesce(text, '')").alias("round_trip"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.judge(docs, quality_rules.fit(docs, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), carry=False)
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows of benchmark whose item_id is divisible by 20; all documents are searched."""
    queries = table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    found = bm25.search(bm25.build(table(spark, sf_dir, "documents")), queries, k=10)
    return found.withColumn("score", F.round("score", 6))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(table(spark, sf_dir, "documents", rows=8))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, archives = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(folder, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = line_crf.score(docs, line_crf.fit(docs, table(spark, sf_dir, "labels")), carry=False)
    held = F.coalesce(F.expr("crc32(cast(row.doc_id as string)) % 5 = 0"), F.lit(False))
    return out.select("row.doc_id", held.alias("held_out"), "score", "predicted")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings", rows=8192)).drop("label")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents", rows=64), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")).drop("groups")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_ngram_jaccard_join, op3_sentencepiece, op4_quality_rules, op5_substring_dedup, op6_bm25_search, op7_lm_scoring, op8_warc, op9_line_dedup, op10_quality_classifier, op11_mixing, op12_vector_codes, op13_tokenizer_alignment)
}

_WORD = "'[^\\x20\\x09-\\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



_KEY = "{'v': v, 'd': doc_id, 's': size}"


def _fill_sql(rows: str, f: str) -> str:
    """Rounds of filling: the documents of ``rows`` nearest below and above each gap, and the best set so far, as tables f0, f1 ..."""
    near = f"{{'miss': abs(gap - words), 'key': {_KEY}}}"
    options = "[{'miss': miss, 'fills': fills}, CASE WHEN over IS NOT NULL THEN {'miss': over.miss, 'fills': list_append(fits, over.key)} END, CASE WHEN fit IS NOT NULL THEN {'miss': fit.miss, 'fills': list_append(fits, fit.key)} END]"
    out = f"""
{f}0 AS (SELECT place, any_value(target) AS goal, any_value(target) - sum(words * times)::BIGINT AS gap, [{{'v': 0::DOUBLE, 'd': 0::BIGINT, 's': 0::BIGINT}}][:0] AS fits, abs(gap) AS miss, fits AS fills FROM {rows} GROUP BY 1),"""
    for i in range(1, mixing.FILLS + 1):
        out += f"""
n{f}{i} AS (SELECT place, min({near}) FILTER (WHERE words <= gap) AS fit, min({near}) FILTER (WHERE words > gap) AS over FROM {rows} JOIN {f}{i - 1} USING (place) WHERE free AND words < 2 * gap AND NOT list_contains(fits, {_KEY}) GROUP BY 1),
m{f}{i} AS (SELECT place, goal, coalesce(fit.miss, gap) AS gap, CASE WHEN fit IS NULL THEN fits ELSE list_append(fits, fit.key) END AS fits, list_min(list_filter({options}, lambda x: x IS NOT NULL)) AS best FROM {f}{i - 1} LEFT JOIN n{f}{i} USING (place)),
{f}{i} AS (SELECT place, goal, gap, fits, best['miss'] AS miss, best['fills'] AS fills FROM m{f}{i}),"""
    return out


_FINITE = "CASE WHEN coalesce(len(embedding), 0) = 0 THEN false ELSE list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) END"


def _round_sql(i: int) -> str:
    """Assignment of all parts to codebook ``i``: (vec_id, p, e, d)."""
    return f"""
d{i} AS (SELECT vec_id, x.p, e, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{i} c USING (p, k) GROUP BY 1, 2, 3),
a{i} AS (SELECT vec_id, p, e, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1),"""


def _learn_sql(i: int) -> str:
    return f"""{_round_sql(i)}
c{i + 1} AS (SELECT p, e, k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT x.p, e, k, floor(sum(x.v)::DOUBLE / count(*))::BIGINT AS v FROM x JOIN a{i} USING (vec_id, p) GROUP BY 1, 2, 3) m USING (p, e, k)),"""


ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)""",
    "op5_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d) x),
f AS (SELECT k, doc_id AS fd, i AS fi FROM v QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) = 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM v JOIN f USING (k) WHERE doc_id <> fd OR i <> fi),
x AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = x.doc_id AND g.p = x.p) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY 1) c USING (doc_id)""",
    "op6_bm25_search": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) x GROUP BY 1, 2),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
a AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS m FROM d),
q AS (SELECT query_id, t, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all({_LOWER}, {_WORD})) AS t FROM benchmark WHERE item_id % 20 = 0) x GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / m))) AS score FROM q JOIN df USING (t) JOIN tf USING (t) JOIN d USING (doc_id), a GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM s QUALIFY rank <= 10""",
    "op11_mixing": f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS size FROM documents),
u AS (SELECT source, doc_id, size, count(*) AS copies, size * count(*) AS words FROM d GROUP BY 1, 2, 3),
s AS (SELECT source, w, place, [5, 2, 1][(place % 3 + 1)::INT] AS weight FROM (SELECT source, sum(words)::BIGINT AS w, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM u GROUP BY 1) y),
l AS (SELECT w, weight, (sum(w) OVER ()::BIGINT * 1.5::DOUBLE - coalesce(sum(2 * w) OVER (ORDER BY 2 * w / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE / sum(weight) OVER (ORDER BY 2 * w / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS level, 2 * w / weight AS r, place FROM s),
v AS (SELECT level FROM l WHERE 2 * w > level * weight ORDER BY r, place LIMIT 1),
t AS (SELECT s.*, coalesce(least(2 * w::DOUBLE, (SELECT level FROM v) * weight), 2 * w::DOUBLE) AS target FROM s),
e AS (SELECT u.*, place, w, target, CASE WHEN w > 0 THEN least(2.0::DOUBLE, target / w) ELSE 0 END AS expected, length(bin(size)) AS kind, (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || size), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / pow(2, 48) AS u FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, floor(expected)::BIGINT AS base, expected - floor(expected) AS chance, CASE WHEN expected > floor(expected) THEN (u / (1 - u)) / ((expected - floor(expected)) / (1 - (expected - floor(expected)))) END AS odds FROM e),
q AS (SELECT *, CASE WHEN odds IS NOT NULL THEN least(odds / (1 + odds), 1 - pow(2, -53)) END AS v FROM o),
b AS (SELECT *, v IS NOT NULL AND words > 0 AS open, chance * words AS part FROM q),
c AS (SELECT *, sum(part) FILTER (WHERE open) OVER (PARTITION BY place) + {mixing.ROUNDING} AS budget FROM b),
i AS (SELECT *, open AND words > budget / {mixing.GIANT} AS giant FROM c),
j AS (SELECT *, giant AND sum(words) OVER (PARTITION BY place, giant ORDER BY v, doc_id NULLS FIRST, size) - words / 2 <= sum(part) OVER (PARTITION BY place, giant) + {mixing.ROUNDING} AS held FROM i),
m AS (SELECT *, greatest(0, budget - coalesce(sum(words) FILTER (WHERE held) OVER (PARTITION BY place), 0)::BIGINT) / sum(part) FILTER (WHERE open AND NOT giant) OVER (PARTITION BY place) AS factor, open AND NOT giant AS ranked FROM j),
g AS (SELECT *, held OR ranked AND sum(words) OVER (PARTITION BY place, kind, ranked ORDER BY v, doc_id NULLS FIRST, size) <= sum(part) OVER (PARTITION BY place, kind, ranked) * factor + {mixing.ROUNDING} AS picked FROM m),
h AS (SELECT *, base + picked::BIGINT AS times, open AND NOT picked AS free FROM g),{_fill_sql("h", "f")}
y AS (SELECT h.*, fills FROM h JOIN f{mixing.FILLS} USING (place))
SELECT doc_id, source, size, w AS source_size, target, size * (times + list_contains(fills, {_KEY})::BIGINT) AS taken FROM (SELECT *, unnest(range(copies)) FROM y) x""",
    "op12_vector_codes": f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE {_FINITE}),
x AS (SELECT vec_id, (i // (len(q) // {vector_codes.PARTS}))::INT AS p, i AS k, q[i + 1] AS v FROM (SELECT vec_id, q, unnest(range(len(q))) AS i FROM k) y),
c0 AS (SELECT p, e, k, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < {vector_codes.ENTRIES}) y USING (vec_id)),{"".join(map(_learn_sql, range(vector_codes.ROUNDS)))}{_round_sql(vector_codes.ROUNDS)}
b AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{vector_codes.ROUNDS} GROUP BY 1),
h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, k)) AS digest FROM c{vector_codes.ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM b JOIN k USING (vec_id), h""",
}
