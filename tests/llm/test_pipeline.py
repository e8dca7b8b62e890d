"""The pipeline's stages against plain ones, with odd rows, empty tables, and columns whose names clash or hold dots."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from memlake.llm import toxicity
from memlake.llm.decontaminate import find_leaks
from memlake.llm.queries import tokenizer_path

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` string, kept_text double, n_bytes string, score string, kept boolean, component_id int, c0 string, carried_0 int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, docs):
    """Real documents, and null, empty, long, repeated and copied texts, in a table whose names clash with the operators' own."""
    some = [(r["doc_id"], r["text"]) for r in docs.where("doc_id < 40").collect()]
    passage = some[3][1][:400]
    more = [(None, some[1][1]), (900, None), (901, ""), (902, " \n"), (903, "word " * 30_000), (904, some[2][1]), (904, some[2][1]), (905, "Before it. " + passage + " After it.")]
    rows = [(i, t, "en", "s", len(t or ""), f"dot{i}", 0.5, "nb", "sc", True, 7, "c", 1) for i, t in some + more]
    return spark.createDataFrame(rows, CLASH)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_are_those_asked_for():
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontaminate", "packing"]


@pytest.mark.parametrize("name", ["toxicity", "near_dedup", "suffix_dedup", "decontaminate"])
def test_stages_keep_columns_and_take_empty_tables(spark, odd, name):
    stage = dict(pipeline.STAGES)[name]
    out = stage(spark, odd, SF)
    assert out.dtypes == odd.dtypes
    if name != "suffix_dedup":
        assert not rows_of(out) - rows_of(odd)
    else:
        assert rows_of(out.drop("text", "n_chars")) == rows_of(odd.drop("text", "n_chars"))
        assert out.where(F.length("text") != F.col("n_chars")).count() == 0
    assert {r["doc_id"] for r in out.collect()} >= {None, 900, 901, 902}
    nothing = stage(spark, odd.limit(0), SF)
    assert nothing.dtypes == odd.dtypes and nothing.count() == 0


def test_toxicity_stage_drops_what_scores_high(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels))
    kept = {r["doc_id"] for r in pipeline.toxicity(spark, docs, SF).collect()}
    assert kept == {r["doc_id"] for r in scored.where(F.col("score") < 0.7).collect()} and len(kept) < docs.count()


def test_near_dedup_stage_keeps_one_of_each_group(spark, docs):
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    lead = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((lead[a], lead[b]))
                lead = {i: x if v == y else v for i, v in lead.items()}
    assert {r["doc_id"] for r in pipeline.near_dedup(spark, docs, SF).collect()} == {i for i, v in lead.items() if i == v}


def test_suffix_dedup_stage_against_brute_force(spark, odd):
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    seen, want = set(), Counter()
    for i in sorted(texts, key=lambda x: (x is None, x)):
        fresh = set()
        for text in texts[i]:
            raw = text.encode()
            gone = set()
            for p in range(len(raw) - 49):
                if raw[p : p + 50] in seen and i is not None:
                    gone |= set(range(p, p + 50))
                fresh.add(raw[p : p + 50])
            want[i, bytes(c for p, c in enumerate(raw) if p not in gone).decode("utf-8", "ignore")] += 1
        if i is not None:
            seen |= fresh
    assert Counter((r["doc_id"], r["text"]) for r in pipeline.suffix_dedup(spark, odd, SF).collect()) == want


def test_decontamination_stage_drops_what_leaks(spark, docs):
    leaks = {r[0] for r in find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").collect()}
    assert {r["doc_id"] for r in pipeline.decontaminate(spark, docs, SF).collect()} == {r["doc_id"] for r in docs.collect()} - leaks


def test_run_packs_what_the_stages_keep(spark, docs):
    from tokenizers import Tokenizer

    out = pipeline.run(spark, SF).collect()
    kept = docs
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in kept.collect()}
    assert {r["doc_id"] for r in out} == set(want)
    for i, n in want.items():
        assert sum(r["length"] for r in out if r["doc_id"] == i) == n
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
