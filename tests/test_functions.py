import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memlake.config import Config, audit_max, blend_weight, budget, cap, length_penalty, pending_max, write_policy
from memlake.functions import refs as R
from memlake.functions import safety as S
from memlake.functions import text as X
from memlake.functions import vectors as V


@pytest.fixture()
def on(spark):
    def run(function, *values):
        names = [f"c{i}" for i in range(len(values))]
        df = spark.createDataFrame([values], ", ".join(f"{n} {'string' if v is None or isinstance(v, str) else 'double'}" for n, v in zip(names, values, strict=True)))
        return df.select(function(*[F.col(n) for n in names]).alias("r")).first()[0]

    return run


def fnv_reference(text: str) -> str:
    units = text.encode("utf-16-le")
    h = 2166136261
    for i in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * 16777619) % 2**32
    out = ""
    while h:
        h, d = divmod(h, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out or "0"


def test_normalize(on):
    assert on(X.normalize_text, "  用户   偏好中文。 ") == "用户 偏好中文"
    assert on(X.normalize_text, "Hello, World!") == "hello, world"
    assert on(X.normalize_text, "ＡＢＣ") == "abc"


def test_fingerprint(on):
    lit = F.lit
    assert on(lambda c: X.record_hash(lit("user_profile"), lit("profile"), lit("*"), lit("lang"), c), "偏好中文。") == "1e6njv7"
    assert on(X.fnv1a, "") == "ztntfp"
    plain = on(lambda c: X.record_hash(lit("semantic"), lit("workspace"), lit("*"), lit(None), c, lit(None)), "x")
    assert plain == on(lambda c: X.record_hash(lit("semantic"), lit("workspace"), lit("*"), lit(None), c, lit("")), "x")
    assert plain != on(lambda c: X.record_hash(lit("semantic"), lit("workspace"), lit("*"), lit(None), c, lit("main")), "x")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=20))
def test_fnv_matches_a_plain_loop(on, text):
    assert on(X.fnv1a, text) == fnv_reference(text)


def test_tokens(on):
    assert on(X.tokenize, "记忆数据") == ["记忆", "忆数", "数据"]
    assert "runn" in on(X.tokenize, "running")
    assert on(X.tokenize, "中") == ["中"]
    assert on(X.tokenize, "构建流程 pnpm") == ["pnpm", "构建", "建流", "流程"]
    assert on(X.tokenize, "für scripts/release.mjs 0.5.9") == ["f", "r", "script", "release", "mjs", "0", "5", "9"]
    assert on(X.tokenize, "é") == []
    assert on(lambda c: X.tokenize(c, stemming=False, bigram=False), "builds 记忆") == ["builds", "记", "忆"]


def test_sentences_and_subject(on):
    assert on(X.split_sentences, "一。二！\n three? four") == ["一。", "二！", "three?", "four"]
    assert on(lambda c: X.derive_subject(c, F.lit("auto")), "use pnpm workspace 12") == "auto.workspace.pnpm"
    assert on(lambda c: X.derive_subject(c, F.lit("auto")), "12 3") is None


def test_similarity(on):
    assert on(X.similarity, "alpha beta", "alpha gamma") == pytest.approx(1 / 3)
    assert on(X.containment, "alpha beta", "alpha beta gamma delta") == 1.0
    assert on(X.containment, "", "alpha") == 0.0


def test_clamp(on):
    assert on(lambda c: X.clamp_text(c, 60), "a\n b​  c") == "a b c"
    assert on(lambda c: X.clamp_text(c, 4), "abcdefghijklmnop") == "abcdefghi…"
    assert on(X.estimate_tokens, "abcdef") == 3


def test_branches(on):
    assert on(X.normalize_branch, " refs/heads/main ") == "main"
    assert on(X.normalize_branch, "a\tb") is None
    assert on(X.branch_from_head, "ref: refs/heads/feature/x\n") == "feature/x"
    assert on(X.branch_from_head, "0123456789abcdef0123456789abcdef01234567") == "01234567"
    assert on(X.branch_from_head, "ref: refs/tags/v1") is None
    assert on(X.branch_from_head, "gitdir: ../x") is None


def test_markers_and_portrait(on):
    assert on(X.markers, "We use pnpm, Docker and tsconfig") == ["pnpm", "typescript", "docker"]
    assert on(lambda c: X.portrait_subject(F.lit("persona"), c), "Voice") == "self.persona.voice"
    assert on(lambda c: X.portrait_subject(F.lit("x"), c), "a b") == "self.work.general"
    assert on(X.merged_text, "long text here", "text") == "long text here"
    assert on(X.merged_text, "one thing", "other") == "one thing；other"


def test_secrets(on):
    scan = lambda c: S.scan_sensitive(S.render_equivalent(c))
    assert on(scan, "key sk-abcdefghijklmnop") == "api-key"
    assert on(scan, "sk-​abcdefghijklmnop123456") == "api-key"
    assert on(scan, "ｓｋ-abcdefghijklmnop1") == "api-key"
    assert on(scan, "密码sk-abcdefghijklmnop") == "api-key"
    assert on(scan, "Bearer abcdefghijklmnopqr") == "bearer-token"
    assert on(scan, "-----BEGIN RSA PRIVATE KEY-----") == "private-key"
    assert on(scan, "password: hunter22") == "password"
    assert on(scan, "11010519491231002X") == "cn-id"
    assert on(scan, "4111 1111 1111 1111") == "bank-card"
    assert on(scan, "just text") is None


def test_masking(on):
    mask = lambda c: S.mask_pii(c, S.render_equivalent(c))
    assert on(mask, "mail alice@example.com now") == "mail a***@example.com now"
    assert on(mask, "call 13812348000") == "call 138****8000"
    assert on(mask, "138​1234​8000") == "138****8000"
    assert on(mask, "ｐlain") == "ｐlain"


def test_exclusions(on):
    why = lambda c: S.exclusion_reason(c, S.render_equivalent(c))
    assert on(why, "记住") == "too-short"
    assert on(why, "use ```code``` here") == "code-block"
    assert on(why, "https://example.com/a") == "pure-url"
    assert on(why, "is this right or not?") == "question"
    assert on(why, "如果以后都这样就好了吧") == "hypothetical"
    assert on(why, "per the docs it is fine") == "quoted"
    assert on(why, "password = abcdefgh") == "sensitive"
    assert on(why, "以后都用 pnpm 管理依赖。") is None


def test_long_runs_are_masked_quickly(spark):
    text = "a" * 200_000
    assert spark.createDataFrame([(text,)], "t string").select(S.mask_pii(F.col("t"), F.col("t"))).first()[0] == text


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0], [1.0])], "a array<double>, b array<double>, z array<double>, s array<double>")
    r = df.select(V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("z")), V.cosine(F.col("a"), F.col("s")), V.normalize(F.col("b")), V.blend(F.lit(0.2), F.lit(0.6), 0.5), V.blend(F.lit(0.2), F.lit(None).cast("double"), 0.5)).first()
    assert r[0] == pytest.approx(0.7071, abs=1e-4) and r[1] is None and r[2] is None
    assert r[3] == pytest.approx([0.7071, 0.7071], abs=1e-4) and r[4] == pytest.approx(0.4) and r[5] == 0.2


def test_refs(spark):
    cfg = Config(refs_max=2)
    df = spark.createDataFrame([([("ses-0123456789ab", 1, 5, "live"), ("", 1, 1, None), ("ses-0123456789ab", 1, 5, "sleep"), ("b", 3, None, "odd"), ("c", None, 9, None)],)], f"refs {R.REFS}")
    r = df.select(R.refs_string(R.normalize_refs(F.col("refs"), cfg)), R.format_refs(F.col("refs"), short=True), R.covers(F.col("refs"), F.lit("c"), F.lit(4)), R.covers(F.col("refs"), F.lit("b"), F.lit(4))).first()
    assert r[0] == "ses-0123456789ab#1-5;b#3"
    assert r[1].startswith("ses-01234567#1-5; ") and r[2] and not r[3]


def test_settings():
    inf, nan = float("inf"), float("nan")
    assert budget(inf, 5) == budget(nan, 5) == budget(0, 5) == budget(-1, 5) == 5 and budget(2, 5) == 2
    assert cap(0, 5) == 0 and cap(inf, 5) == inf and cap(-1, 5) == 5
    assert pending_max(Config(pending_max=0)) == 0 and pending_max(Config(pending_max=nan)) == 50
    assert audit_max(Config(audit_max=-1)) == 50 and audit_max(Config(audit_max=0)) == 0
    assert length_penalty(Config(search_length_penalty=-1)) == 0.3 and blend_weight(Config(embedder_weight=2)) == 0.5
    assert write_policy(Config(write_policy=" ASK ")) == "ask" and write_policy(Config(write_policy="x")) == "auto"


def test_small_text_functions(spark):
    from memlake.functions import text as X

    row = spark.range(1).select(
        X.merged_text(F.lit("Keeps answers short."), F.lit("keeps answers short")).alias("held"), X.merged_text(F.lit("one thing"), F.lit("quite another thing")).alias("both"), X.normalize_facet(F.lit(" Persona ")).alias("facet"), X.normalize_facet(F.lit("odd")).alias("odd"),
        X.stamp(F.lit(1_704_067_200_000)).alias("stamp"), X.short_session(F.lit("ses-84a547da-1")).alias("short"), X.vector_key(F.lit("Alpha."), F.lit(None), F.array(F.lit("T"))).alias("key"), X.vector_key(F.lit("alpha"), F.lit(""), F.array(F.lit("t"))).alias("same"),
        X.write_policy(F.lit(" ASK ")).alias("ask"), X.write_policy(F.lit("x")).alias("auto"), X.language(F.lit("EN")).alias("en"), X.portrait_subject(F.lit("persona"), F.lit("Voice")).alias("subject"), X.portrait_subject(F.lit(None).cast("string"), F.lit("no key!")).alias("general"),
    ).first()
    assert (row["held"], row["both"]) == ("Keeps answers short.", "quite another thing；one thing")
    assert (row["facet"], row["odd"], row["stamp"], row["short"]) == ("persona", "work", "2024-01-01 00:00", "ses-84a547da")
    assert row["key"] == row["same"] and row["key"].startswith("emb1:")
    assert (row["ask"], row["auto"], row["en"], row["subject"], row["general"]) == ("ask", "auto", "en", "self.persona.voice", "self.work.general")
