"""Queries against their SQL on small tables that only large ones are like: fingerprints in common, letters that grow, long queues."""

import functools
import operator
import random

import duckdb
import pytest

from memlake.functions import text as X
from memlake.operators import govern, recall
from memlake.plans import more_queries, queries  # noqa: F401 - both register


@pytest.fixture()
def same(spark, tmp_path):
    """Runs a query and its SQL over documents (doc_id, text) and other tables; returns their rows, which agree."""

    def run(name, documents, **tables):
        documents = [(i, t, "de", "s") for i, t in documents]
        made = {"documents": (documents, "doc_id bigint, text string, lang string, source string"), "labels": ([(-1, 1)], "doc_id bigint, quality bigint")} | tables
        db = duckdb.connect()
        for table, (data, schema) in made.items():
            spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        want = db.execute(queries.SQL[name])
        columns = [c[0] for c in want.description]
        got = sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()))
        assert got == sorted(want.fetchall())
        return got

    return run


def test_texts_of_one_fingerprint_are_two(spark, same):
    a, b = "cavgsozq", "snorqtud"
    hashes = spark.createDataFrame([(a,), (b,)], "t string").select(X.fnv1a("t")).distinct()
    assert hashes.count() == 1
    assert same("backfill_anti_join", [(17, a), (1, b), (34, "c"), (2, "C.")]) == [("17",)]
    assert same("twin_lookup", [(19, a), (1, b), (38, "c"), (2, "C.")]) == [("38", "2")]


def test_mentions_of_one_fingerprint_are_two_records(same):
    assert [r[:2] for r in same("dedup_merge", [(1, "wleougua"), (2, "ghwsrevm"), (3, "Wleougua."), (4, "other")])] == [(1, 2), (2, 1), (4, 1)]


def test_a_sharp_s_in_capitals_is_the_same_text(same):
    assert same("present_guard", [(6, "Die Straße \u1f80 \ufb01"), (12, "plain words"), (4, "gone")]) == [("12",), ("6",)]


def test_a_queue_of_more_than_a_page(same):
    assert "共 1000 条" in same("pending_text", [(19 * (i + 1), f"text {i}") for i in range(1100)])[0][0]


@pytest.mark.parametrize("kind", ["containment", "jaccard"])
def test_stripes_of_a_block_miss_no_pair(spark, monkeypatch, kind):
    rng = random.Random(3)
    sets = [set(rng.choices([f"w{i}" for i in range(60)], [1 / (i + 1) for i in range(60)], k=rng.choice([1, 2, 3, 8, 20, 40]))) for _ in range(120)]
    sets += [set(rng.sample(sorted(s), max(1, len(s) - 1))) for s in sets[:40]] + sets[40:60] + [set()]
    rows = [(i, i % 2, sorted(s)) for i, s in enumerate(sets)]
    want = {}
    for i, bi, x in rows:
        for j, bj, y in rows[i + 1 :]:
            same = len({*x} & {*y})
            score = same / (min(len(x), len(y)) if kind == "containment" else len({*x} | {*y})) if bi == bj and x and y else 0
            if score >= 0.7:
                want[i, j] = score
    df = spark.createDataFrame(rows, "id bigint, b bigint, tokens array<string>")
    for most in (150, 10_000):
        monkeypatch.setattr(govern, "STRIPE_TOKENS", most)
        got = govern.token_pairs(df, ["b"], 0.7, kind).collect()
        assert {(r["a"], r["b"]): r["score"] for r in got} == want and len(got) == len(want) > 50


def test_messages_that_one_record_settles_are_not_looked_for(spark, rows, monkeypatch):
    pool = rows(dict(id="a", kind="semantic", text="alpha beta gamma delta epsilon"), dict(id="b", kind="semantic", text="zeta eta"), dict(id="c", kind="semantic", text="theta 12"))
    said = ["alpha beta", "alpha 12", "zeta eta theta", "theta 12", "", "12 34", "Beta, gamma!"]
    messages = spark.createDataFrame([(str(i), t) for i, t in enumerate(said)], "query_id string, query string")
    plain = recall.recall(pool, messages, 1_704_067_200_000, mode="memory").select("query_id").distinct()
    whole = recall.recall
    asked = []
    monkeypatch.setattr(recall, "recall", lambda records, queries, *a: asked.append(queries.count()) or whole(records, queries, *a))
    got = recall.triggers(pool, messages, 1_704_067_200_000, long=8).collect()
    assert asked == [4] and sum(r["triggered"] for r in got) == plain.count() == 4 and sum(r["total"] for r in got) == 7


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_scores_at_the_gate_do_not_depend_on_the_order_of_sums(spark, monkeypatch, broadcast):
    monkeypatch.setattr(recall, "BROADCAST_TOKENS", broadcast)
    rng = random.Random(4)
    words = [f"k{i}" for i in range(40)]
    asked = {q: rng.sample(words, 9) for q in range(12)}
    pool = [(f"r{i}", rng.sample(words, rng.randint(1, 30))) for i in range(150)]
    # a record with all of a query and 31 times as many tokens has exactly the gate's score: 1 / (1 + 0.3 * log2(32))
    pool += [(f"q{q}-{i}", rng.sample(own + [f"x{j}" for j in range(30 * len(own))], 31 * len(own))) for q, own in asked.items() for i in range(4)]
    records = spark.createDataFrame(pool, "id string, tokens array<string>")
    queries_ = spark.createDataFrame([(q, " ".join(own)) for q, own in asked.items()], "query_id int, query string")
    tokens = recall.query_tokens(queries_)
    idf = {r["token"]: r["idf"] for r in recall.idf_table(recall.postings(records, tokens), tokens, spark.createDataFrame([(len(pool),)], "n bigint")).collect()}
    want = {q: functools.reduce(operator.add, [idf[t] for t in sorted(own)]) for q, own in asked.items()}  # sum() would compensate
    rows = recall.explain(records, queries_).where("id like concat('q', query_id, '-%')").collect()
    assert len(rows) == 12 * 4 * 9 and {r["passes"] for r in rows} == {True, False}
    assert all(r["score"] == want[r["query_id"]] / (want[r["query_id"]] * 2.5) and r["passes"] == (r["score"] >= 0.4) for r in rows)
