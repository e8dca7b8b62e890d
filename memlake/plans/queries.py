"""Every operator of the engine as a query over the test tables, with SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import safety as S
from memlake.functions import text as X
from memlake.functions.refs import format_refs
from memlake.functions.vectors import tiles
from memlake.operators import capture, filters, govern, portrait, provenance, recall, render, replay
from memlake.operators import write as writing
from memlake.plans.tables import CFG, DAY, NOW, RECORDS_SQL, benchmark_queries, events, records, sessions, table
from memlake.schema import make_records
from memlake.sources import sessions as logs
from memlake.streaming import turns as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


WS = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def q(text: str) -> str:
    return text.replace("'", "''")


def norm(c: str) -> str:
    flat = f"trim(regexp_replace(translate({c}, '{X.WIDE}', '{q(X.NARROW)}'), '{WS}+', ' ', 'g'), ' ')"
    return f"lower(trim(regexp_replace({flat}, '[{X.END_MARKS}]+$', ''), ' '))"


def toks(c: str) -> str:
    """Tokens of text without CJK characters, which the tables don't have."""
    return f"list_transform(regexp_extract_all({norm(c)}, '[a-z0-9]+'), lambda w: CASE WHEN length(w) > 4 AND NOT regexp_full_match(w, '[0-9]+') THEN regexp_replace(w, '(ing|ed|s)$', '') ELSE w END)"


def jtrim(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def fnv(c: str) -> str:
    units = f"list_transform(string_split({c}, ''), lambda x: CAST(unicode(x) AS UBIGINT))"
    return f"list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), {units}), lambda h, x: (xor(h, x) * 16777619) % 4294967296)"


def clamp(c: str, most: int) -> str:
    flat = f"trim(regexp_replace(regexp_replace(regexp_replace({c}, '\\p{{Cc}}', ' ', 'g'), '[\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2066}}-\\x{{2069}}\\x{{FEFF}}]', '', 'g'), '{WS}+', ' ', 'g'), ' ')"
    return f"(CASE WHEN length({flat}) <= {most} THEN {flat} ELSE substr({flat}, 1, {most - 1}) || '…' END)"


def view(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '\\p{{Cf}}', '', 'g'), '\\p{{Cc}}', ' ', 'g')"


RANK = "pinned DESC, importance DESC, confidence DESC, id"
REC_TOKENS = f"rt AS (SELECT id, list_distinct({toks('concat_ws(chr(32), text, subject, tag)')}) AS tokens FROM pool)"


BENCHMARK = "SELECT item_id AS query_id, text AS query FROM benchmark"


def scored_sql(mode: str, gate: float, asked: str = BENCHMARK, least: int = 2) -> str:
    match = "CAST(times AS DOUBLE) / n_times" if mode == "query" else f"CASE WHEN informative < {least} THEN 0 ELSE least(1.0, CAST(hits AS DOUBLE) / greatest(1, least(4, n_tokens))) END"
    return f"""{RECORDS_SQL}, pool AS (SELECT * FROM records WHERE status = 'active'), {REC_TOKENS},
post AS (SELECT id, len(tokens) AS n_tokens, unnest(tokens) AS token FROM rt),
qw AS (SELECT query_id, {toks('query')} AS w FROM ({asked})),
qt AS (SELECT query_id, token, count(*) AS times, any_value(nt) AS n_times, any_value(nq) AS n_query FROM (SELECT query_id, len(w) AS nt, len(list_distinct(w)) AS nq, unnest(w) AS token FROM qw) GROUP BY 1, 2),
df AS (SELECT token, count(*) AS df FROM post GROUP BY 1),
idf AS (SELECT t.token, coalesce(df, 0) AS df, ln(1 + (SELECT count(*) FROM pool) / CAST(1 + coalesce(df, 0) AS DOUBLE)) AS idf FROM (SELECT DISTINCT token FROM qt) t LEFT JOIN df USING (token)),
mx AS (SELECT query_id, sum(idf) AS max_idf FROM qt JOIN idf USING (token) GROUP BY 1),
pr AS (SELECT query_id, id, count(*) AS hits, sum(times) AS times, sum(idf) AS raw, sum(CASE WHEN length(token) >= 2 AND NOT regexp_full_match(token, '[0-9]+') THEN 1 ELSE 0 END) AS informative, any_value(n_tokens) AS n_tokens, any_value(n_query) AS n_query, any_value(n_times) AS n_times
  FROM post JOIN qt USING (token) JOIN idf USING (token) GROUP BY 1, 2),
sc AS (SELECT query_id, pool.*, {match} AS match, least(1.0, greatest(0.0, raw / (max_idf * (1 + 0.3 * log2(1 + CAST(n_tokens AS DOUBLE) / n_query))))) AS relevance FROM pr JOIN mx USING (query_id) JOIN pool USING (id)),
hits AS (SELECT *, CASE WHEN match = 0 THEN 0 ELSE round(0.6 * relevance + 0.3 * importance + 0.1 / (1 + greatest(0, {NOW} - observed) / CAST({DAY} AS DOUBLE) / 30), 12) END AS score FROM sc WHERE match >= {gate}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {RANK}) AS rank FROM hits)"""


def _recalled(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    pool = records(spark, sf_dir).where(filters.active())
    out = recall.recall(pool, benchmark_queries(spark, sf_dir), NOW, CFG, mode)
    return out.select("query_id", "id", F.round("match", 6).alias("match"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {scored_sql('query', 0.34)} SELECT query_id, id, round(match, 6) AS match, round(score, 6) AS score, rank FROM ranked WHERE rank <= 8")
def recall_lexical_topk(spark, sf_dir):
    return _recalled(spark, sf_dir, "query")


@query(f"WITH {scored_sql('memory', 0.4)} SELECT query_id, id, round(match, 6) AS match, round(score, 6) AS score, rank FROM ranked WHERE rank <= 8")
def recall_memory_mode(spark, sf_dir):
    return _recalled(spark, sf_dir, "memory")


@query(f"WITH {scored_sql('query', 0.34)} SELECT token, df, round(idf, 6) AS idf FROM idf")
def idf_table(spark, sf_dir):
    pool = records(spark, sf_dir).where(filters.active())
    tokens = recall.query_tokens(benchmark_queries(spark, sf_dir))
    held = recall.postings(pool, tokens)
    return recall.idf_table(held, tokens, pool.agg(F.count(F.lit(1)).alias("n"))).select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH {scored_sql('query', 0.34)}, ex AS (SELECT c.doc_id AS expected_id, b.item_id AS query_id FROM (SELECT b.item_id, min(d.doc_id) AS doc_id FROM benchmark b JOIN pool d ON contains(d.text, b.text) GROUP BY 1) c JOIN benchmark b ON c.item_id = b.item_id),
pl AS (SELECT query_id, min(CASE WHEN CAST(expected_id AS VARCHAR) = id THEN rank END) AS place FROM ranked LEFT JOIN ex USING (query_id) WHERE rank <= 8 GROUP BY 1)
SELECT count(*) AS n, avg(CASE WHEN coalesce(place = 1, false) THEN 1.0 ELSE 0 END) AS top1, avg(CASE WHEN coalesce(place <= 3, false) THEN 1.0 ELSE 0 END) AS top3, avg(CASE WHEN pl.query_id IS NOT NULL THEN 1.0 ELSE 0 END) AS trigger_rate FROM benchmark b LEFT JOIN pl ON b.item_id = pl.query_id""")
def eval_recall(spark, sf_dir):
    pool = records(spark, sf_dir).where(filters.active())
    asked = benchmark_queries(spark, sf_dir)
    found = provenance.holders(pool.select(F.col("doc_id").alias("id"), "text"), asked.select(F.col("query").alias("line")))
    expected = found.join(asked.withColumnRenamed("query", "line"), "line").groupBy("query_id").agg(F.min("id").cast("string").alias("id"))
    return recall.evaluate(pool, asked, expected, NOW, CFG)


@query(f"""WITH {RECORDS_SQL}, pool AS (SELECT * FROM records WHERE status = 'active'), {REC_TOKENS}, post AS (SELECT id, len(tokens) AS n_tokens, unnest(tokens) AS token FROM rt),
qw AS (SELECT item_id AS query_id, list_distinct({toks('text')}) AS w FROM benchmark), qt AS (SELECT query_id, len(w) AS n_query, unnest(w) AS token FROM qw),
df AS (SELECT token, count(*) AS df FROM post GROUP BY 1), idf AS (SELECT query_id, n_query, token, ln(1 + (SELECT count(*) FROM pool) / CAST(1 + coalesce(df, 0) AS DOUBLE)) AS idf FROM qt LEFT JOIN df USING (token)),
al AS (SELECT post.*, idf.query_id, idf.n_query, idf.idf, mx FROM post JOIN idf USING (token) JOIN (SELECT query_id, sum(idf) AS mx FROM idf GROUP BY 1) m ON idf.query_id = m.query_id),
sc AS (SELECT *, sum(idf) OVER (PARTITION BY id, query_id) AS raw FROM al), fin AS (SELECT *, least(1.0, raw / (mx * (1 + 0.3 * log2(1 + CAST(n_tokens AS DOUBLE) / n_query)))) AS score FROM sc)
SELECT query_id, id, token, round(idf * score / raw, 6) AS contribution, round(score, 6) AS score, score >= 0.4 AS passes FROM fin""")
def explain_match(spark, sf_dir):
    out = recall.explain(records(spark, sf_dir).where(filters.active()), benchmark_queries(spark, sf_dir), CFG)
    return out.select("query_id", "id", "token", F.round("contribution", 6).alias("contribution"), F.round("score", 6).alias("score"), "passes")


@query(f"SELECT doc_id, md5({norm('text')}) AS digest FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalize_text(F.col("text")).cast("binary")).alias("digest"))


_B36 = " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(h // {36**k} % 36 AS BIGINT) + 1, 1)" for k in range(6, -1, -1))


@query(f"SELECT doc_id, ltrim({_B36}, '0') AS hash FROM (SELECT doc_id, {fnv('concat_ws(chr(124), \'semantic\', \'workspace\', source, lang, ' + norm('coalesce(text, \'\')') + ')')} AS h FROM documents)")
def fingerprint(spark, sf_dir):
    hashed = X.record_hash(F.lit("semantic"), F.lit("workspace"), F.col("source"), F.col("lang"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", hashed.alias("hash"))


@query(f"SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {toks('text')} AS t FROM documents)")
def tokenize(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", X.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(f"""WITH t AS (SELECT doc_id, lang, source, list_distinct({toks('text')}) AS k FROM documents), p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.k, b.k)) AS s, len(a.k) AS na, len(b.k) AS nb FROM t a JOIN t b ON a.lang = b.lang AND a.source = b.source AND a.doc_id < b.doc_id)
SELECT a, b, round(CAST(s AS DOUBLE) / least(na, nb), 6) AS score FROM p WHERE na > 0 AND nb > 0 AND CAST(s AS DOUBLE) / least(na, nb) >= 0.7""")
def near_dup_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "text")
    return govern.similar_pairs(d, 0.7, ["lang", "source"]).select("a", "b", F.round("score", 6).alias("score"))


@query(f"""WITH t AS (SELECT doc_id, list_distinct({toks('text')}) AS k FROM documents), l AS (SELECT DISTINCT list_sort(list_distinct({toks('text')})) AS k FROM benchmark)
SELECT DISTINCT doc_id AS id FROM t, l WHERE len(t.k) > 0 AND len(l.k) > 0 AND CAST(len(list_intersect(t.k, l.k)) AS DOUBLE) / len(list_distinct(list_concat(t.k, l.k))) >= 0.4""")
def echo_semi_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return govern.echo(d, table(spark, sf_dir, "benchmark").select(F.col("text").alias("line")), 0.4)


_SECRETS_RE2 = [
    ("api-key", r"\b(?:sk-[A-Za-z0-9_-]{12,}|AKIA[0-9A-Z]{12,}|ghp_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,})\b"),
    ("bearer-token", rf"(?i)\bBearer{WS}+[A-Za-z0-9._~+/-]{{16,}}=*"),
    ("private-key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("password", rf"(?i)(?:密码|口令|passwd|password){WS}*[:：=]{WS}*[^{WS[1:-1]}]{{6,}}"),
    ("cn-id", r"\b[0-9]{17}[0-9Xx]\b"),
    ("bank-card", r"\b(?:[0-9][ -]?){16,19}\b"),
]
SAMPLES = ["key sk-abcdefghijklmnop here", "密码sk-abcdefghijklmnop", "Bearer abcdefghijklmnopqr==", "-----BEGIN RSA PRIVATE KEY-----", "password: hunter22x", "id 11010519491231002X", "card 4111 1111 1111 1111", "call 13812348000", "mail alice@example.com", "nothing here at all", "如果以后都这样就好了吧", "https://example.com/a", "is this right or not?", "他说这样就可以了吧好"]


def secret_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{q(p)}') THEN '{r}'" for r, p in _SECRETS_RE2) + " END"


_INLINE = ", ".join(f"({-i}, '{q(s)}')" for i, s in enumerate(SAMPLES, 1))
_TEXTS = f"x AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_INLINE}) t(doc_id, text))"


def _texts(spark, sf_dir):
    more = spark.createDataFrame([(-i, s) for i, s in enumerate(SAMPLES, 1)], "doc_id bigint, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(more)


@query(f"WITH {_TEXTS} SELECT doc_id, {secret_sql(view('text'))} AS reason FROM x")
def secret_scan(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", S.scan_sensitive(S.render_equivalent(F.col("text"))).alias("reason"))


_EMAIL_RE2 = r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*(@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"  # the same without what bounds an engine that backtracks
_PHONE_RE2 = r"\b(1[3-9][0-9])[0-9]{4}([0-9]{4})\b"


@query(f"WITH {_TEXTS}, v AS (SELECT doc_id, text, {view('text')} AS v FROM x) SELECT doc_id, md5(CASE WHEN regexp_matches(v, '{_EMAIL_RE2}') OR regexp_matches(v, '{_PHONE_RE2}') THEN regexp_replace(regexp_replace(v, '{_EMAIL_RE2}', '\\1***\\2', 'g'), '{_PHONE_RE2}', '\\1****\\2', 'g') ELSE text END) AS digest FROM v")
def pii_mask(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.md5(S.mask_pii(F.col("text"), S.render_equivalent(F.col("text"))).cast("binary")).alias("digest"))


_SPLIT = f"list_filter(list_transform(string_split_regex(regexp_replace(text, '([。！？!?])', '\\1' || chr(10), 'g'), '\\r?\\n'), lambda s: {jtrim('s')}), lambda s: length(s) > 0)"
_WHY = f"""CASE WHEN length(s) < 8 THEN 'too-short' WHEN contains(s, '```') THEN 'code-block' WHEN regexp_matches(s, '^https?://[^{WS[1:-1]}]+$') THEN 'pure-url' WHEN ({secret_sql(view('s'))}) IS NOT NULL THEN 'sensitive'
 WHEN regexp_matches(s, '[?？]{WS}*$') THEN 'question' WHEN regexp_matches(s, '(^|[{WS[1:-1]}，,。])(如果|假如|要是|万一|假设|倘若)') THEN 'hypothetical' WHEN regexp_matches(s, '(?i)(他说|她说|文档里写|文档说|according to|per the docs)') THEN 'quoted' END"""


@query(f"WITH c AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT doc_id, 0, text FROM (VALUES {_INLINE}) t(doc_id, text)), r AS (SELECT conv_id, turn, {_SPLIT} AS l FROM c), e AS (SELECT conv_id, turn, unnest(l) AS s, unnest(range(len(l))) AS place FROM r) SELECT conv_id, turn, place, md5(s) AS digest, {_WHY} AS excluded FROM e")
def sentence_exclusion(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    more = spark.createDataFrame([(-i, 0, s) for i, s in enumerate(SAMPLES, 1)], "conv_id bigint, turn bigint, text string")
    rows = capture.sentences(c.unionByName(more))
    return rows.select("conv_id", "turn", F.col("place").cast("long").alias("place"), F.md5(F.col("sentence").cast("binary")).alias("digest"), "excluded")


@query(f"""WITH t AS (SELECT conv_id, turn, list_filter(list_distinct({toks('text')}), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+')) AS k FROM conversations)
SELECT conv_id, turn, CASE WHEN len(k) > 0 THEN 'auto.' || array_to_string(list_transform(list_sort(list_transform(k, lambda w: {{'n': -length(w), 't': w}}))[1:2], lambda x: x.t), '.') END AS subject FROM t""")
def subject_derive(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.derive_subject(F.col("text"), F.lit("auto")).alias("subject"))


@query(f"""WITH {RECORDS_SQL}, s AS (SELECT *, first_value(id) OVER w AS winner, first_value(origin) OVER w AS worigin FROM records WHERE status = 'active' WINDOW w AS (PARTITION BY kind, scope_key, subject, field ORDER BY observed DESC, {RANK}))
SELECT winner, id AS loser, worigin NOT IN ('user_explicit', 'user_correction') AND origin IN ('user_explicit', 'user_correction') AS blocked FROM s WHERE winner <> id""")
def conflict_winners(spark, sf_dir):
    return govern.conflicts(records(spark, sf_dir))


_EFF = f"CASE WHEN pinned OR kind = 'procedural' OR (kind = 'agent_self' AND origin <> 'model_proposed') THEN importance ELSE importance * pow(2.0, -(greatest(0, {NOW} - observed) / CAST({DAY} AS DOUBLE)) / CASE kind WHEN 'user_profile' THEN 180 WHEN 'project_gist' THEN 30 WHEN 'episodic' THEN 60 WHEN 'semantic' THEN 120 ELSE 90 END) END"


@query(f"WITH {RECORDS_SQL} SELECT id, round({_EFF}, 6) AS effective, status = 'active' AND NOT pinned AND kind NOT IN ('agent_self', 'project_gist') AND {_EFF} < 0.15 AND ({NOW} - observed) / CAST({DAY} AS DOUBLE) >= 180 AS archive FROM records")
def decay_archive(spark, sf_dir):
    return records(spark, sf_dir).select("id", F.round(govern.effective_importance(NOW), 6).alias("effective"), govern.archivable(NOW, CFG).alias("archive"))


@query(f"""WITH {RECORDS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY kind, scope_key, subject ORDER BY {RANK}) AS place FROM records WHERE status = 'active' AND kind <> 'agent_self' AND tag <> 'summary')
SELECT kind, scope_key, subject, count(*) AS n, md5('关于 ' || subject || ' 的既有记录（' || count(*) || ' 条）：' || string_agg(text, '；' ORDER BY place) FILTER (WHERE place <= 5)) AS digest, string_agg(id, ',' ORDER BY place) AS absorbed FROM r GROUP BY 1, 2, 3 HAVING count(*) > 5""")
def subject_summary(spark, sf_dir):
    rows = govern.summaries(records(spark, sf_dir), CFG)
    return rows.select("kind", F.col("scope.key").alias("scope_key"), "subject", "n", F.md5(F.col("text").cast("binary")).alias("digest"), F.array_join("absorbed", ",").alias("absorbed"))


_LINE = f"'- ' || {clamp('text', 150)}"


@query(f"""WITH {RECORDS_SQL}, l AS (SELECT id, scope_key, pinned, importance, confidence, {_LINE} AS line FROM records WHERE status = 'active'), c AS (SELECT *, CAST(ceil(length(line) / 2.5) AS BIGINT) AS cost FROM l),
u AS (SELECT *, sum(cost) OVER (PARTITION BY scope_key ORDER BY {RANK} ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY scope_key ORDER BY {RANK}) AS place FROM c) SELECT scope_key, id, md5(line) AS digest, cost, CAST(used AS BIGINT) AS used, place FROM u WHERE used <= 300""")
def budget_fill(spark, sf_dir):
    rows = records(spark, sf_dir).where(filters.active()).withColumn("scope_key", F.col("scope.key"))
    from memlake.schema import ranking

    out = render.fill(rows, ranking(), F.concat(F.lit("- "), render.item(CFG)), F.lit(300), CFG, ["scope_key"])
    return out.select("scope_key", "id", F.md5(F.col("line").cast("binary")).alias("digest"), "cost", "used", "place")


_T = render.TEXTS["zh"]
_HEAD = render.tokens_of(f"{_T.facts_header}\n{_T.facts_footer}", CFG)
_GIST = render.tokens_of(f"{_T.gist_header}\n{_T.gist_footer}", CFG)


@query(f"""WITH {RECORDS_SQL}, p AS (SELECT *, CASE WHEN kind = 'project_gist' THEN 'gist' ELSE 'facts' END AS section FROM records WHERE status = 'active' AND kind NOT IN ('agent_self', 'episodic') AND tag <> 'summary' AND scope_key = 'src1'),
l AS (SELECT *, CASE WHEN section = 'gist' THEN '- ' || {clamp('text', 150)} ELSE '- (workspace) ' || {clamp('text', 150)} END AS line FROM p), c AS (SELECT *, CAST(ceil(length(line) / 2.5) AS BIGINT) AS cost FROM l),
u AS (SELECT *, sum(cost) OVER (PARTITION BY section ORDER BY {RANK} ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY section ORDER BY {RANK}) AS place FROM c)
SELECT section, place, id, md5(line) AS digest, cost, CAST(used AS BIGINT) AS used FROM u WHERE used <= CASE WHEN section = 'gist' THEN 90 ELSE 300 - {_HEAD} - {_GIST} * (SELECT max(CASE WHEN section = 'gist' THEN 1 ELSE 0 END) FROM p) END""")
def resident_block(spark, sf_dir):
    out = render.context_block(records(spark, sf_dir), CFG, "src1")
    return out.select("section", "place", "id", F.md5(F.col("line").cast("binary")).alias("digest"), "cost", "used")


_WORK = 120 - render.tokens_of(_T.work_header, CFG)


@query(f"""WITH {RECORDS_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY {RANK}) AS place, '- ' || {clamp('text', 150)} AS line FROM records WHERE status = 'active' AND kind = 'agent_self' AND origin IN ('user_explicit', 'user_correction') AND confidence >= 0.8),
c AS (SELECT *, CAST(ceil(length(line) / 2.5) AS BIGINT) AS cost FROM p WHERE place <= 12), u AS (SELECT *, CAST(sum(cost) OVER (ORDER BY place) AS BIGINT) AS used FROM c)
SELECT 'confirmed' AS section, place, id, line, cost, used FROM u WHERE used <= {_WORK}""")
def self_block(spark, sf_dir):
    return render.self_block(records(spark, sf_dir), CFG)


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.concat(F.lit("s-"), F.col("conv_id").cast("string")).alias("sessionId"), F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).alias("text"))


@query(f"""WITH {RECORDS_SQL}, t AS (SELECT id, ref_session AS session, ref_from AS "from", ref_to AS "to", list_distinct({toks('text')}) AS k FROM records WHERE ref_session IS NOT NULL), m AS (SELECT 's-' || conv_id AS s, turn AS seq, list_distinct({toks('text')}) AS k FROM conversations),
j AS (SELECT t.id, t.session, t."from", t."to", count(m.seq) AS events, list_distinct(flatten(list(list_intersect(t.k, coalesce(m.k, []))))) AS seen, any_value(len(t.k)) AS n FROM t LEFT JOIN m ON t.session = m.s AND m.seq BETWEEN t."from" AND t."to" GROUP BY 1, 2, 3, 4)
SELECT id, session, "from", "to", events, round(CASE WHEN n > 0 THEN CAST(len(seen) AS DOUBLE) / n ELSE 0 END, 6) AS coverage FROM j""")
def refs_range_verify(spark, sf_dir):
    out = provenance.verify(records(spark, sf_dir), _messages(spark, sf_dir))
    return out.select("id", F.col("sessionId").alias("session"), "from", "to", "events", F.round("coverage", 6).alias("coverage"))


@query(f"WITH {RECORDS_SQL} SELECT id, kind, status, ref_session AS session FROM records WHERE (starts_with(ref_session, '12') OR starts_with(regexp_replace(ref_session, '^[^-]*-', ''), '12')) AND 3 BETWEEN ref_from AND ref_to")
def trace_point(spark, sf_dir):
    return provenance.trace(records(spark, sf_dir), "12", 3).select("id", "kind", "status", F.col("sessionId").alias("session"))


@query("""WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') AND conv_id % 13 <> 0),
t AS (SELECT 's-' || conv_id AS session, turn * 2 AS seq, role, """ + clamp("coalesce(text, '')", 1 << 29) + """ AS text FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq, role, text) AS pos FROM t WHERE text <> ''),
g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY pos ROWS UNBOUNDED PRECEDING) - CASE WHEN role = 'user' THEN 1 ELSE 0 END AS grp FROM n),
b AS (SELECT *, row_number() OVER (PARTITION BY session, grp, role ORDER BY pos DESC) AS back, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session, grp) AS has FROM g)
SELECT session, pos, seq, role, md5(text) AS digest FROM b WHERE has = 1 AND (role = 'user' OR back <= 3)""")
def transcript_context(spark, sf_dir):
    wide = CFG.with_(sleep_max_chars_per_session=1e9, sleep_max_chars_total=1e12)
    out = replay.transcripts(sessions(spark, sf_dir), events(spark, sf_dir), wide)
    return out.select(F.col("sessionId").alias("session"), "pos", "seq", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


SCRIPT = """c AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') AND conv_id % 13 <> 0),
t AS (SELECT conv_id, 's-' || conv_id AS session, turn * 2 AS seq, turn, role, {clamp} AS text FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq, role, text) AS pos FROM t WHERE text <> ''),
g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY pos ROWS UNBOUNDED PRECEDING) - CASE WHEN role = 'user' THEN 1 ELSE 0 END AS grp FROM n),
b AS (SELECT *, row_number() OVER (PARTITION BY session, grp, role ORDER BY pos DESC) AS back, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session, grp) AS has FROM g),
w AS (SELECT * FROM b WHERE has = 1 AND (role = 'user' OR back <= 3)),
q AS (SELECT conv_id, session, grp, sum(length(text)) AS chars, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS own, count(*) FILTER (WHERE role <> 'user') AS others, row_number() OVER (PARTITION BY session ORDER BY grp DESC) AS k FROM w GROUP BY 1, 2, 3),
f(session, k, grp, others, size, used, kept) AS (SELECT session, CAST(0 AS BIGINT), CAST(-1 AS HUGEINT), CAST(0 AS BIGINT), CAST(0 AS HUGEINT), CAST(0 AS HUGEINT), 3 FROM (SELECT DISTINCT session FROM q)
  UNION ALL SELECT session, k, grp, others, CASE kept WHEN 2 THEN chars WHEN 1 THEN own ELSE 0 END, used + CASE kept WHEN 2 THEN chars WHEN 1 THEN own ELSE 0 END, kept FROM (
    SELECT q.*, f.used, CASE WHEN f.kept = 0 THEN 0 WHEN f.used + q.chars <= {each} THEN 2 WHEN f.used + q.own <= {each} THEN 1 ELSE 0 END AS kept FROM f JOIN q ON q.session = f.session AND q.k = f.k + 1)),
s AS (SELECT session, sum(size) AS size, sum(CASE kept WHEN 3 THEN 0 WHEN 2 THEN 0 WHEN 1 THEN others ELSE 1 + others END) AS dropped, CAST(split_part(session, '-', 2) AS BIGINT) AS conv FROM f GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY conv DESC, session) AS k FROM s WHERE size > 0),
h(k, session, total, fits) AS (SELECT CAST(0 AS BIGINT), '', CAST(0 AS HUGEINT), false UNION ALL SELECT o.k, o.session, h.total + CASE WHEN h.total + o.size <= {all} THEN o.size ELSE 0 END, h.total + o.size <= {all} FROM h JOIN o ON o.k = h.k + 1),
script AS (SELECT w.*, f.kept, s.dropped FROM w JOIN f ON w.session = f.session AND w.grp = f.grp JOIN h ON h.session = w.session AND h.fits JOIN s ON s.session = w.session WHERE f.kept = 2 OR (f.kept = 1 AND w.role = 'user'))"""


def script_sql(each: int, total: int) -> str:
    return SCRIPT.format(clamp=clamp("coalesce(text, '')", each), each=each, all=total)


@query(f"""WITH RECURSIVE {script_sql(800, 20_000)} SELECT session AS "sessionId", '/w/' || (conv_id % 7) AS cwd, {NOW} + conv_id * 100000 AS "createdAt", pos, seq, {NOW} + conv_id * 100000 + turn * 1000 AS "time", role, text, CAST(dropped AS BIGINT) AS dropped FROM script""")
def session_budget_fold(spark, sf_dir):
    tight = CFG.with_(sleep_max_chars_per_session=800, sleep_max_chars_total=20_000)
    return replay.transcripts(sessions(spark, sf_dir), events(spark, sf_dir), tight)


@query(f"""WITH RECURSIVE {RECORDS_SQL}, s AS (SELECT id, doc_id, subject, observed, CASE WHEN doc_id % 30 <> 1 THEN CAST(doc_id - 6 AS VARCHAR) END AS old FROM records WHERE kind = 'agent_self'),
e AS (SELECT s.id, p.id AS up FROM s JOIN s p ON s.old = p.id AND s.subject = p.subject), walk(id, head) AS (SELECT id, id FROM s WHERE id NOT IN (SELECT id FROM e) UNION ALL SELECT e.id, walk.head FROM e JOIN walk ON e.up = walk.id)
SELECT any_value(s.subject) AS subject, head, string_agg(s.id, ',' ORDER BY s.observed, s.id) AS ids, max(s.observed) AS latest FROM walk JOIN s USING (id) GROUP BY head HAVING count(*) >= 2""")
def revision_chain(spark, sf_dir):
    return portrait.history(records(spark, sf_dir)).select("subject", "head", F.array_join("ids", ",").alias("ids"), "latest")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS c FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(c, 6) AS cosine, rank FROM r WHERE rank <= 5""")
def cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = v.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "vector")  # the query set
    p = tiles(asked, v, 6, [("id", False)], floor=None, digits=9).where("id <> query_id")  # one more than asked for: a vector finds itself
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id"))).where("rank <= 5")
    return p.select("query_id", F.col("id").alias("vec_id"), F.round("cosine", 6).alias("cosine"), "rank")


@query(f"""WITH {scored_sql('query', 0)}, v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
x AS (SELECT a.vec_id AS query_id, pool.*, greatest(0, list_cosine_similarity(a.e, b.e)) AS cosine FROM v a JOIN benchmark ON a.vec_id = item_id, v b JOIN pool ON pool.doc_id = b.vec_id),
y AS (SELECT x.*, round(0.5 * least(1, greatest(0, coalesce(hits.score, 0))) + 0.5 * cosine, 12) AS blended FROM x LEFT JOIN hits ON hits.query_id = x.query_id AND hits.id = x.id),
z AS (SELECT query_id, id, blended AS score, false AS fallback, row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, {RANK}) AS rank FROM y),
l AS (SELECT query_id, id, score, true AS fallback, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {RANK}) AS rank FROM hits WHERE match >= 0.34 AND query_id NOT IN (SELECT vec_id FROM v))
SELECT query_id, id, round(score, 6) AS score, rank, fallback FROM (SELECT * FROM z UNION ALL BY NAME SELECT * FROM l) WHERE rank <= 8""")
def hybrid_blend(spark, sf_dir):
    pool = records(spark, sf_dir).where(filters.active())
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    asked = benchmark_queries(spark, sf_dir)
    own = vectors.select(F.col("id").cast("long").alias("query_id"), "vector").join(asked.select("query_id"), "query_id", "left_semi")
    return recall.semantic(pool, vectors, asked, own, NOW, CFG, "hybrid").withColumn("score", F.round("score", 6))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS hour_count FROM events""")
def hourly_quota(spark, sf_dir):
    return capture.trailing_hour(table(spark, sf_dir, "events"), "user_id").select("event_id", "hour_count")


def _writes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), F.format_string("%012d", "event_id").alias("id"), F.col("event_type").alias("hash"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, printf('%012d', event_id) AS id, event_type AS hash, epoch_us(ts) // 1000 AS "at", row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
f(key, n, id, hash, "at", acc, reason) AS (SELECT key, n, id, hash, "at", [{'t': "at", 'h': hash}], NULL::VARCHAR FROM e WHERE n = 1
  UNION ALL SELECT key, n, id, hash, "at", CASE WHEN reason IS NULL THEN list_append(acc, {'t': "at", 'h': hash}) ELSE acc END, reason FROM (
    SELECT e.*, f.acc, CASE WHEN len(list_filter(f.acc, lambda x: x.t > e."at" - 3600000)) >= 20 THEN 'over-hour-quota' WHEN len(list_filter(f.acc, lambda x: x.h = e.hash AND e."at" - x.t < 86400000)) > 0 THEN 'throttled' END AS reason FROM f JOIN e ON f.key = e.key AND e.n = f.n + 1))
SELECT key, id, hash, "at", reason IS NULL AS accepted, reason FROM f""")
def hash_throttle(spark, sf_dir):
    return streams.batch_quotas(_writes(spark, sf_dir))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events),
n AS (SELECT a.user_id, a.event_type, a.turn, min(b.turn) AS nxt FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.turn >= a.turn + 3 GROUP BY 1, 2, 3),
shown(user_id, event_type, turn) AS (SELECT user_id, event_type, min(turn) FROM e GROUP BY 1, 2 UNION ALL SELECT n.user_id, n.event_type, n.nxt FROM shown s JOIN n ON s.user_id = n.user_id AND s.event_type = n.event_type AND s.turn = n.turn),
l AS (SELECT e.event_id, e.turn - coalesce(max(s.turn), -999) AS since FROM e LEFT JOIN shown s ON e.user_id = s.user_id AND e.event_type = s.event_type AND s.turn < e.turn GROUP BY e.event_id, e.turn)
SELECT event_id, CAST(since AS BIGINT) AS since, since >= 3 AS cooled FROM l""")
def cooldown(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("turn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return provenance.cooled(e.select("event_id", "user_id", "event_type", "turn"), 3, ["user_id", "event_type"]).select("event_id", "since", "cooled")


MARKS = [("mit", "mit license"), ("apache", "apache license"), ("rights", "all rights reserved"), ("mail", "@mail"), ("token", "token"), ("junk", "!!")]
_MARK_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{n}' END" for n, p in MARKS) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH m AS (SELECT source, unnest({_MARK_SQL}) AS m FROM documents), g AS (SELECT source, list_distinct(list(m)) AS s FROM m GROUP BY 1)
SELECT source, '这个工作区看起来涉及：' || array_to_string(list_filter([{', '.join(f"'{n}'" for n, _ in MARKS)}], lambda x: list_contains(s, x))[1:6], '、') || '。' AS text FROM g WHERE len(s) >= 2""")
def marker_gist(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.explode(X.markers(F.coalesce("text", F.lit("")), MARKS)).alias("m"))
    g = d.groupBy("source").agg(F.collect_set("m").alias("s")).where(F.size("s") >= 2)
    return g.select("source", X.gist_text(F.filter(F.array(*[F.lit(n) for n, _ in MARKS]), lambda x: F.array_contains(F.col("s"), x))).alias("text"))


@query(f"WITH {RECORDS_SQL} SELECT id, branch FROM records WHERE branch IS NULL OR branch = 'feature/1'")
def branch_filter(spark, sf_dir):
    return records(spark, sf_dir).where(filters.branch_visible("feature/1", CFG)).select("id", "branch")


@query(f"WITH {RECORDS_SQL} SELECT id, kind, status FROM records WHERE status IN ('active', 'archived') AND kind = 'semantic' AND tag = 'plain'")
def status_filter(spark, sf_dir):
    return filters.recall_pool(records(spark, sf_dir), "semantic", "workspace", "plain", True).select("id", "kind", "status")


@query(f"WITH {RECORDS_SQL}, p AS (SELECT *, count(*) OVER () AS total FROM records WHERE status = 'active') SELECT id, total, total > 50 AS truncated FROM p ORDER BY id LIMIT 50")
def list_page(spark, sf_dir):
    return filters.page(records(spark, sf_dir).where(filters.active()), None, 100, 50).select("id", "total", "truncated")


@query(f"WITH {RECORDS_SQL} SELECT kind, status, count(*) AS n, count(ref_session) AS with_refs FROM records GROUP BY 1, 2")
def stats(spark, sf_dir):
    return provenance.stats(records(spark, sf_dir))


@query(f"WITH {RECORDS_SQL} SELECT count(*) AS n, count(ref_session) AS with_refs, CAST(round(100.0 * count(ref_session) / count(*)) AS BIGINT) AS percent FROM records")
def refs_ratio(spark, sf_dir):
    return provenance.refs_ratio(records(spark, sf_dir))


@query(f"WITH {RECORDS_SQL} SELECT id, ref_session || '#' || ref_from || '-' || ref_to AS refs FROM records WHERE ref_session IS NOT NULL")
def refs_format(spark, sf_dir):
    return records(spark, sf_dir).where("refs is not null").select("id", format_refs(F.col("refs")).alias("refs"))


@query(f"WITH {RECORDS_SQL} SELECT branch, count(*) AS n, branch = 'feature/1' AS current FROM records WHERE branch IS NOT NULL GROUP BY 1")
def branch_summary(spark, sf_dir):
    return provenance.branches(records(spark, sf_dir), "feature/1")


@query("""WITH a AS (SELECT unnest(['created','merged','pending','approved','rejected-pending','rejected','invalidated','archived','forgotten']) AS action), n AS (SELECT ['created','merged','rejected','pending','odd'][event_id % 5 + 1] AS action, count(*) AS n FROM events GROUP BY 1) SELECT action, coalesce(n, 0) AS n FROM a LEFT JOIN n USING (action)""")
def audit_counts(spark, sf_dir):
    names = F.array(*map(F.lit, ("created", "merged", "rejected", "pending", "odd")))
    return provenance.action_counts(table(spark, sf_dir, "events").select(F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("action")))


@query("""WITH a AS (SELECT epoch_us(ts) // 1000 AS "at", CAST(event_id AS VARCHAR) AS id, event_type FROM events) SELECT "at", id, event_type FROM a ORDER BY "at" DESC, id DESC LIMIT 50""")
def audit_ring(spark, sf_dir):
    return provenance.ring(table(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("string").alias("id"), "event_type"), CFG)


SAID = ["记住：以后都用 pnpm 管理依赖。", "你搞错了，这里应该用 workspace 作用域。", "我们决定用 Spark 来处理所有数据。我更喜欢简短的回答方式。", "这只是一句普通的话而已。", "如果以后都这样就好了吧", "记住：以后都用 pnpm 管理依赖。记住：以后都用 pnpm 管理依赖！", "记住第一条规则要遵守。记住第二条规则要遵守。记住第三条规则要遵守。记住第四条规则要遵守。"]
SAID_SQL = "SELECT conv_id || '#' || turn AS message_id, text FROM conversations WHERE role = 'user' UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('said{i}', '{s}')" for i, s in enumerate(SAID)) + ") t(message_id, text)"
_SIG = " ".join(f"WHEN regexp_matches(s, '{p}') THEN {i}" for i, (*_, p) in enumerate(capture.SIGNALS))
_SIGS = ", ".join(f"({i}, '{n}', '{k}', '{o}', {c}::DOUBLE, {m}::DOUBLE)" for i, (n, k, o, c, m, _) in enumerate(capture.SIGNALS))


def _said(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("#", "conv_id", "turn").alias("message_id"), "text")
    return m.unionByName(spark.createDataFrame([(f"said{i}", s) for i, s in enumerate(SAID)], "message_id string, text string"))


@query(f"""WITH c AS ({SAID_SQL}), r AS (SELECT message_id, {_SPLIT} AS l FROM c), e AS (SELECT message_id, unnest(l) AS s, unnest(range(len(l))) AS place FROM r),
g AS (SELECT *, CASE WHEN ({_WHY}) IS NULL THEN CASE {_SIG} END END AS sig, {jtrim("regexp_replace(s, '[。！？!?]+$', '')")} AS body FROM e), k AS (SELECT * FROM g JOIN (VALUES {_SIGS}) v(sig2, signal, kind, origin, confidence, importance) ON sig = sig2),
d AS (SELECT *, row_number() OVER (PARTITION BY message_id, kind, {norm('body')} ORDER BY place) AS n FROM k), f AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY confidence DESC, importance DESC, place) AS t FROM d WHERE n = 1)
SELECT message_id, place, signal, kind, origin, confidence, importance, body AS text FROM f WHERE t <= 3""")
def capture_candidates(spark, sf_dir):
    return capture.candidates(_said(spark, sf_dir), CFG).select("message_id", F.col("place").cast("long").alias("place"), "signal", "kind", "origin", "confidence", "importance", "text")


@query(f"""WITH c AS ({SAID_SQL}), r AS (SELECT message_id, {_SPLIT} AS l FROM c), e AS (SELECT message_id, unnest(l) AS s, unnest(range(len(l))) AS place FROM r),
g AS (SELECT *, {_WHY} AS why, CASE {_SIG} END AS sig, {jtrim("regexp_replace(s, '[。！？!?]+$', '')")} AS body FROM e), k AS (SELECT *, coalesce(why, CASE WHEN sig IS NULL THEN 'no-signal' END) AS reason FROM g LEFT JOIN (VALUES {_SIGS}) v(sig2, signal, kind, origin, confidence, importance) ON sig = sig2),
d AS (SELECT * REPLACE (CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY message_id, reason IS NULL, kind, {norm('body')} ORDER BY place) > 1 THEN 'duplicate-in-turn' ELSE reason END AS reason) FROM k),
f AS (SELECT CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY message_id, reason IS NULL ORDER BY confidence DESC, importance DESC, place) > 3 THEN 'over-turn-quota' ELSE reason END AS reason FROM d)
SELECT reason, count(*) AS n FROM f WHERE reason IS NOT NULL GROUP BY 1""")
def capture_skipped(spark, sf_dir):
    return capture.skipped(_said(spark, sf_dir), CFG)


def _mentions(spark, sf_dir):
    d = records(spark, sf_dir).select(F.lit("semantic").alias("kind"), F.struct(F.lit("profile").alias("level"), F.lit("*").alias("key")).alias("scope"), "text", "importance", "confidence", "origin", "pinned", "observedAt", "id", F.col("scope.key").alias("sessionId"), F.col("doc_id").alias("arrival"))
    return make_records(d, NOW).join(d.select("id", "sessionId", "arrival"), "id")


@query(f"""WITH {RECORDS_SQL}, h AS (SELECT *, {norm('text')} AS k, row_number() OVER (PARTITION BY {norm('text')} ORDER BY doc_id) AS n, row_number() OVER (PARTITION BY {norm('text')}, scope_key ORDER BY doc_id) AS s FROM records),
g AS (SELECT min(doc_id) AS first_id, count(*) AS n, max(confidence) AS confidence, count(DISTINCT scope_key) AS sessions, bool_or(pinned) AS pinned, max(list_position(['observed','model_proposed','user_correction','user_explicit'], origin)) AS o,
  list({{'i': importance, 'b': CASE WHEN n > 1 AND s = 1 THEN 0.1::DOUBLE ELSE 0::DOUBLE END}} ORDER BY doc_id) AS l FROM h GROUP BY k)
SELECT first_id, n, confidence, round(list_reduce(l, lambda a, x: {{'i': CASE WHEN x.b > 0 THEN least(1.0::DOUBLE, greatest(a.i, x.i) + x.b) ELSE greatest(a.i, x.i) END, 'b': 0::DOUBLE}}).i, 6) AS importance, sessions, pinned, ['observed','model_proposed','user_correction','user_explicit'][o] AS origin FROM g""")
def dedup_merge(spark, sf_dir):
    rows = _mentions(spark, sf_dir)
    out = writing.merge_by_hash(rows.limit(0), rows, CFG, exact=True)
    return out.select(F.col("id").cast("long").alias("first_id"), "n", "confidence", F.round("importance", 6).alias("importance"), F.size("reinforcement.sessions").cast("long").alias("sessions"), "pinned", "origin")


@query(f"""WITH {RECORDS_SQL}, a AS (SELECT DISTINCT {norm('text')} AS k FROM records WHERE status = 'active') SELECT id FROM records WHERE status <> 'active' AND {norm('text')} NOT IN (SELECT k FROM a)""")
def backfill_anti_join(spark, sf_dir):
    # 32 bits of a fingerprint don't tell some 100 000 texts apart
    r = records(spark, sf_dir).withColumn("plain", F.sha2(X.normalize_text(F.col("text")), 256))
    return r.where("status <> 'active'").join(r.where(filters.active()).select("plain").distinct(), "plain", "left_anti").select("id")


@query(f"""WITH {RECORDS_SQL}, a AS (SELECT {norm('text')} AS k, id FROM records WHERE status = 'active') SELECT p.id, a.id AS twin FROM records p JOIN a ON {norm('p.text')} = a.k WHERE p.status = 'pending'""")
def twin_lookup(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("plain", F.sha2(X.normalize_text(F.col("text")), 256))
    twins = r.where(filters.active()).select("plain", F.col("id").alias("twin"))
    return r.where("status = 'pending'").join(twins, "plain").select("id", "twin")


MERGES = f"""mg AS (SELECT id, observed, kind || '|' || scope_key || '|' || subject AS bucket, list_distinct({toks('text')}) AS k FROM records WHERE status = 'active' AND kind NOT IN ('project_gist', 'agent_self') AND tag <> 'summary' AND subject <> ''),
mo AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY observed, id) AS n FROM mg WHERE len(k) > 0),
mp AS (SELECT a.bucket, a.n, list(b.id ORDER BY b.n) AS likes FROM mo a JOIN mo b ON a.bucket = b.bucket AND a.n < b.n AND CAST(len(list_intersect(a.k, b.k)) AS DOUBLE) / least(len(a.k), len(b.k)) >= 0.7 GROUP BY 1, 2),
mr AS (SELECT mo.bucket, mo.n, mo.id, coalesce(mp.likes, []) AS likes FROM mo LEFT JOIN mp ON mo.bucket = mp.bucket AND mo.n = mp.n),
ms(bucket, n, lead, own, used) AS (SELECT DISTINCT bucket, CAST(0 AS BIGINT), '', []::VARCHAR[], []::VARCHAR[] FROM mo
  UNION ALL SELECT bucket, n, id, own, list_concat(used, own) FROM (SELECT r.bucket, r.n, r.id, s.used, CASE WHEN list_contains(s.used, r.id) THEN []::VARCHAR[] ELSE list_filter(r.likes, lambda x: NOT list_contains(s.used, x)) END AS own FROM ms s JOIN mr r ON s.bucket = r.bucket AND r.n = s.n + 1)),
mm AS (SELECT lead, unnest(list_prepend(lead, own)) AS id FROM ms WHERE len(own) > 0)"""


@query(f"WITH RECURSIVE {RECORDS_SQL}, {MERGES} SELECT lead, id FROM mm")
def merge_groups(spark, sf_dir):
    return govern.merge_groups(records(spark, sf_dir), CFG)


@query(f"""WITH RECURSIVE {RECORDS_SQL}, {MERGES}, sz AS (SELECT lead, count(*) - 1 AS merged FROM mm GROUP BY 1), pr AS (SELECT lead, coalesce(sum(merged) OVER (ORDER BY lead ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sz),
ch AS (SELECT mm.* FROM mm JOIN pr USING (lead) WHERE before < 200), gs AS (SELECT lead, max(r.importance) AS i, max(r.confidence) AS c, max(r.observed) AS o FROM ch JOIN records r USING (id) GROUP BY 1),
m1 AS (SELECT r.* REPLACE (CASE WHEN ch.lead IS NOT NULL AND ch.lead <> r.id THEN 'archived' ELSE r.status END AS status, CASE WHEN ch.lead = r.id THEN gs.i ELSE r.importance END AS importance, CASE WHEN ch.lead = r.id THEN gs.c ELSE r.confidence END AS confidence, CASE WHEN ch.lead = r.id THEN gs.o ELSE r.observed END AS observed) FROM records r LEFT JOIN ch USING (id) LEFT JOIN gs ON gs.lead = ch.lead),
co AS (SELECT id, origin, first_value(id) OVER v AS winner, first_value(origin) OVER v AS worigin FROM m1 WHERE status = 'active' WINDOW v AS (PARTITION BY kind, scope_key, subject, field ORDER BY observed DESC, {RANK})),
lo AS (SELECT id FROM co WHERE winner <> id AND NOT (worigin NOT IN ('user_explicit', 'user_correction') AND origin IN ('user_explicit', 'user_correction'))),
m2 AS (SELECT * REPLACE (CASE WHEN id IN (SELECT id FROM lo) THEN 'invalid' ELSE status END AS status) FROM m1),
ar AS (SELECT id FROM m2 WHERE status = 'active' AND NOT pinned AND kind NOT IN ('agent_self', 'project_gist') AND {_EFF} < 0.15 AND ({NOW} - observed) / CAST({DAY} AS DOUBLE) >= 180 ORDER BY id LIMIT 200),
m3 AS (SELECT * REPLACE (CASE WHEN id IN (SELECT id FROM ar) THEN 'archived' ELSE status END AS status) FROM m2),
su AS (SELECT kind, 'active' AS status FROM m3 WHERE status = 'active' AND kind <> 'agent_self' AND tag <> 'summary' GROUP BY kind, scope_key, subject HAVING count(*) > 5)
SELECT kind, status, count(*) AS n FROM (SELECT kind, status FROM m3 UNION ALL SELECT kind, status FROM su) GROUP BY 1, 2""")
def consolidate(spark, sf_dir):
    return govern.consolidate(records(spark, sf_dir).drop("doc_id"), NOW, CFG).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


@query()
def portrait_converge(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("#", "conv_id", "turn").alias("candidate_id"), "text", F.lit("work").alias("facet"), F.lit("en").alias("subject"), F.lit("model_proposed").alias("origin"), F.lit(0.7).alias("confidence"))
    return portrait.converge(c, records(spark, sf_dir), CFG)


@query(f"""WITH {RECORDS_SQL}, i AS (SELECT conv_id || '#' || turn AS input_id, turn AS arrival, CASE WHEN turn % 2 = 0 THEN 'model_proposed' ELSE 'user_explicit' END AS origin, text, {view('text')} AS v FROM conversations WHERE role = 'user'),
m AS (SELECT *, CASE WHEN trim(text, ' ') = '' THEN 'rejected_invalid' WHEN ({secret_sql('v')}) IS NOT NULL THEN 'rejected_sensitive' END AS code, CASE WHEN regexp_matches(v, '{_EMAIL_RE2}') OR regexp_matches(v, '{_PHONE_RE2}') THEN regexp_replace(regexp_replace(v, '{_EMAIL_RE2}', '\\1***\\2', 'g'), '{_PHONE_RE2}', '\\1****\\2', 'g') ELSE text END AS masked FROM i),
x AS (SELECT *, ltrim({_B36}, '0') AS hash FROM (SELECT *, {fnv("concat_ws('|', 'semantic', 'workspace', '*', '', " + norm(jtrim('masked')) + ")")} AS h FROM m)),
a AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY input_id) AS n, 'm_' || hash || '_' || first_value(input_id) OVER (PARTITION BY hash ORDER BY arrival, 'm_' || hash || '_' || input_id) AS rid FROM x WHERE code IS NULL AND origin = 'user_explicit'),
q AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY arrival, input_id) AS again FROM x WHERE code IS NULL AND origin = 'model_proposed'),
p AS (SELECT input_id, row_number() OVER (ORDER BY arrival, input_id) + (SELECT count(*) FROM records WHERE status = 'pending') AS place FROM q WHERE again = 1)
SELECT input_id, true AS ok, CASE WHEN n = 1 THEN 'created' ELSE 'merged' END AS outcome, rid AS id, hash FROM a
UNION ALL SELECT input_id, again = 1 AND place <= 50, CASE WHEN again > 1 THEN 'already_pending' WHEN place > 50 THEN 'pending_queue_full' ELSE 'pending' END, CASE WHEN again = 1 AND place <= 50 THEN 'm_' || hash || '_' || input_id END, hash FROM q LEFT JOIN p USING (input_id)
UNION ALL SELECT input_id, false, code, NULL, hash FROM x WHERE code IS NOT NULL""")
def write_path(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    rows = c.select(F.concat_ws("#", "conv_id", "turn").alias("input_id"), F.col("turn").alias("arrival"), F.concat(F.lit("s-"), F.col("conv_id").cast("string")).alias("sessionId"), F.lit("semantic").alias("kind"), F.when(F.col("turn") % 2 == 0, "model_proposed").otherwise("user_explicit").alias("origin"), "text")
    return writing.write(records(spark, sf_dir).drop("doc_id"), rows, NOW, CFG.with_(write_policy="ask"))[1]


_EXPLICIT_RE2 = "(?i)(记住|记一下|记下|帮我记|以后都|以后也|从现在起|别再|不要再用|下次要|remember|always|never)"


@query(f"""WITH RECURSIVE {script_sql(120_000, 300_000)}, m AS (SELECT session || '#' || pos AS message_id, conv_id, text FROM script WHERE role = 'user' AND regexp_matches(text, '{_EXPLICIT_RE2}')), r AS (SELECT message_id, conv_id, {_SPLIT} AS l FROM m), e AS (SELECT message_id, conv_id, unnest(l) AS s, unnest(range(len(l))) AS place FROM r),
sg AS (SELECT *, CASE WHEN ({_WHY}) IS NULL THEN CASE {_SIG} END END AS sig, {jtrim("regexp_replace(s, '[。！？!?]+$', '')")} AS body FROM e), k AS (SELECT * FROM sg JOIN (VALUES {_SIGS}) v(sig2, signal, kind, origin, confidence, importance) ON sig = sig2),
d AS (SELECT *, row_number() OVER (PARTITION BY message_id, kind, {norm('body')} ORDER BY place) AS n FROM k), fc AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY confidence DESC, importance DESC, place) AS t FROM d WHERE n = 1),
fi AS (SELECT kind, signal, CASE WHEN kind = 'user_profile' THEN '' ELSE CAST(conv_id % 7 AS VARCHAR) END AS key, {norm('body')} AS body FROM fc WHERE t <= 3 AND kind <> 'agent_self' AND origin = 'user_explicit')
SELECT (SELECT count(DISTINCT session) FROM script) AS sessions, (SELECT count(*) FROM script) AS messages, (SELECT CAST(coalesce(sum(length(text)), 0) AS BIGINT) FROM script) AS chars, (SELECT count(*) FROM fi) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fi)) AS duplicates, greatest(0, (SELECT count(*) FROM (SELECT DISTINCT * FROM fi)) - 20) AS truncated""")
def replay_plan(spark, sf_dir):
    return replay.plan(records(spark, sf_dir).drop("doc_id"), sessions(spark, sf_dir), events(spark, sf_dir), NOW, CFG).stats


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def windowed_counts(spark, sf_dir):
    return streams.windowed_counts(table(spark, sf_dir, "events")).select("start", "event_type", "n")


@query("""WITH c AS (SELECT 's-' || conv_id AS session, turn, role FROM conversations WHERE role IN ('user', 'assistant')) SELECT session, max(turn * 2 + CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS last_seq FROM c GROUP BY 1""")
def last_seq(spark, sf_dir):
    return provenance.last_per_session(events(spark, sf_dir)).select(F.col("sessionId").alias("session"), "last_seq")


@query("""WITH c AS (SELECT 's-' || conv_id AS session, turn, role, coalesce(text, '') AS text FROM conversations WHERE role IN ('user', 'assistant')), g AS (SELECT *, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM c)
SELECT session, CAST(t + 1 AS BIGINT) AS turn, count(CASE WHEN role = 'user' AND text <> '' THEN 1 END) AS n_messages FROM g GROUP BY 1, 2 HAVING count(CASE WHEN role = 'assistant' THEN 1 END) > 0""")
def streaming_turns(spark, sf_dir):
    from memlake.plans.lineage import shared_folder

    folder = f"{shared_folder(spark)}/turns-{uuid.uuid4().hex}"
    events(spark, sf_dir).repartition("sessionId").sortWithinPartitions("sessionId", "seq").write.parquet(f"{folder}/in")
    stream = logs.event_stream(spark, f"{folder}/in", "parquet")
    run = streams.turns(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("sessionId").alias("session"), "turn", F.col("n_messages").cast("long").alias("n_messages"))
