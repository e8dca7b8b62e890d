"""The queries opN_<name> of the training-data operators and their SQL: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.ann import K, nearest
from memlake.llm.common import held_out, table
from memlake.llm.decontaminate import find_leaks
from memlake.llm.langid import identify_language
from memlake.llm.langid import train as train_language
from memlake.llm.licenses import DOUBTFUL, GATES, PRIORITIES, families, scan_licenses
from memlake.llm.licenses import rules as license_rules
from memlake.llm.neardup import near_duplicates
from memlake.llm.packing import pack
from memlake.llm.quality import score_quality
from memlake.llm.quality import train as train_quality
from memlake.llm.suffixdedup import remove_repeats
from memlake.llm.toxicity import THRESHOLD, score_toxicity
from memlake.llm.toxicity import train as train_toxicity
from memlake.llm.urlfilter import RULES, SOFT, SOFT_LIMIT, SOFT_WEIGHT, STRICT, filter_urls

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(rows.where(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id"), rows)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept_text")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs.select("doc_id", "text"), train_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_score", "worst_start", "worst_end")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_language(docs, train_language(docs))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_nearest, op2_suffix_dedup, op3_near_duplicates, op4_decontaminate, op5_toxicity, op6_url_filter, op7_best_fit_packing, op8_language_id, op9_quality, op10_licenses)}


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def nearest_sql(k: int = K) -> str:
    product = "list_reduce(list_prepend(0::DOUBLE, list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), lambda x, y: x + y)"
    return f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT * FROM e WHERE vec_id IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, {product} AS score FROM u a JOIN u b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""


def near_duplicates_sql() -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s), f AS (SELECT doc_id, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM f a JOIN f b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON c.a = x.doc_id JOIN n y ON c.b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, n AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept FROM n JOIN r ON n.doc_id = r.a GROUP BY 1, 2"""


def url_filter_sql() -> str:
    terms = ", ".join(f"('{t}', {w}::DOUBLE, {s})" for s, group in (("true", STRICT), ("false", SOFT)) for t, w in group.items())
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH c AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS c FROM pages),
h AS (SELECT page_id, n, {lower.format("regexp_extract(c, '^[^/]*')")} AS host, substr(c, length(regexp_extract(c, '^[^/]*')) + 1) AS path FROM c),
t AS (SELECT n, count(*) FILTER (WHERE strict) AS n_strict, count(*) FILTER (WHERE NOT strict) AS n_soft, coalesce(sum(weight) FILTER (WHERE NOT strict), 0) AS soft, sum(weight) AS weight FROM h JOIN (VALUES {terms}) v(term, weight, strict) ON regexp_matches(host || chr(10) || {lower.format("path")}, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY 1),
r AS (SELECT n, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM h JOIN (VALUES {rules}) v(rh, rp, verdict) ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(n_strict, 0) > 0 OR (coalesce(n_soft, 0) >= {SOFT_LIMIT} AND soft >= {SOFT_WEIGHT}) THEN 'block' ELSE 'allow' END) AS verdict, CAST(coalesce(n_strict, 0) AS INTEGER) AS n_strict, CAST(coalesce(n_soft, 0) AS INTEGER) AS n_soft, coalesce(weight, 0) AS weight FROM h LEFT JOIN t USING (n) LEFT JOIN r USING (n)"""


def licenses_sql() -> str:
    words = ["|".join(f" {w} " for w in f) for f in families()]
    table_ = ", ".join(f"({i}, {p}, '{k}', '{x}', '{label}', {w}::DOUBLE, {str(b).lower()})" for (i, p, _, x, label, w, b), k in zip(license_rules(), words, strict=True))
    gate = " OR ".join(f"contains(norm, '{g}')" for g in GATES)
    has = ", ".join(f"CASE WHEN regexp_matches(norm, '{w}') THEN '{w}' END" for w in sorted(set(words)))
    spaces = "(length({0}) - length(replace({0}, ' ', '')))".format
    reach = " ".join(f"WHEN {p} THEN max(CASE WHEN priority <= {p} THEN stop END) OVER o" for p in range(PRIORITIES + 1))
    return f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g'), ' ') AS t FROM documents),
w AS (SELECT n, doc_id, CASE WHEN t = '' THEN '' ELSE ' ' || t || ' ' END AS norm FROM d), c AS (SELECT n, doc_id, CAST({spaces("norm")} / 2 AS BIGINT) AS n_words, norm, {gate} AS gated, [{has}] AS has FROM w),
m AS (SELECT n, gated, rule, priority, label, weight, base, regexp_extract_all(norm, pattern) AS m, string_split_regex(norm, pattern) AS b FROM c JOIN (VALUES {table_}) v(rule, priority, keyword, pattern, label, weight, base) ON list_contains(has, keyword)),
e AS (SELECT n, gated, rule, priority, label, weight, base, unnest(range(len(m))) AS place, unnest(m) AS m, unnest(b[1:len(m)]) AS b FROM m WHERE len(m) > 0),
s AS (SELECT *, CAST({spaces("m")} / 2 AS BIGINT) AS size, CAST(sum({spaces("b")} / 2 + {spaces("m")} / 2) OVER (PARTITION BY n, rule ORDER BY place) AS BIGINT) AS stop FROM e QUALIFY gated OR m <> '{DOUBTFUL}'),
k AS (SELECT *, stop - size AS start, base OR coalesce((CASE priority {reach} END) < stop, true) AS kept FROM s WINDOW o AS (PARTITION BY n ORDER BY stop - size, stop DESC, priority, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT n, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word, array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE base))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE kept))), ',') AS labels, max(weight) FILTER (WHERE kept) AS score, count(*) FILTER (WHERE kept) AS n_detections FROM k GROUP BY 1)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score, coalesce(n_detections, 0) AS n_detections FROM c LEFT JOIN g USING (n)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; models, suffix arrays, edit distances and tokenizers are tested otherwise."""
    return {"op1_nearest": nearest_sql(), "op3_near_duplicates": near_duplicates_sql(), "op6_url_filter": url_filter_sql(), "op10_licenses": licenses_sql()}
