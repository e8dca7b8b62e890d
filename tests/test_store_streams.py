import zstandard
from pyspark.sql import functions as F

from memlake.plans.tables import events
from memlake.schema import EVENT_DDL
from memlake.sources import sessions as logs
from memlake.sources import store as files
from memlake.streaming import turns as streams

NOW = 1_704_067_200_000
SF = "/root/testdata/sf0.001"


def test_store_keeps_versions(spark, rows, tmp_path):
    store = files.Store(spark, str(tmp_path / "s"))
    assert store.records().count() == 0 and store.mark("x") == 0
    store.append(rows(dict(id="a", kind="semantic", text="one"), dict(id="b", kind="semantic", text="two")))
    store.append(rows(dict(id="a", kind="semantic", text="uno")))
    assert {r["id"]: r["text"] for r in store.records().collect()} == {"a": "uno", "b": "two"}
    store.append(rows(dict(id="a", kind="semantic", text="eins")), batch="x")
    store.append(rows(dict(id="a", kind="semantic", text="uno!")), batch="x")  # a repeated batch replaces itself
    assert store.versions().count() == 4
    store.delete(store.records().where("id = 'b'"))
    store.mark_used(spark.createDataFrame([("a",)], "id string"), 5)
    assert [(r["id"], r["text"], r["useCount"], r["lastUsedAt"]) for r in store.with_usage().collect()] == [("a", "uno!", 1, 5)]
    store.set_mark("x", 3)
    store.set_mark("x", 4)
    assert store.mark("x") == 4


def test_export_and_import(spark, rows, tmp_path):
    r = rows(dict(id="a", kind="semantic", text="one", pinned=True, origin="user_explicit", confidence=0.9), dict(id="b", kind="episodic", text="two"))
    files.export(r, str(tmp_path / "e"), NOW)
    again = files.read_export(spark, str(tmp_path / "e"))
    assert again.count() == 2
    odd = again.withColumn("kind", F.when(F.col("id") == "b", "odd").otherwise(F.col("kind"))).withColumn("confidence", F.lit(7.0))
    made, counts = files.import_records(odd, NOW)
    assert [(x["text"], x["origin"], x["pinned"], x["confidence"]) for x in made.collect()] == [("one", "observed", False, 1.0)]
    assert {x["outcome"]: x["n"] for x in counts.collect()} == {"imported": 1, "kind": 1}
    files.write_documents(r, str(tmp_path / "d"))


def test_log_files(spark, tmp_path):
    pack = zstandard.ZstdCompressor().compress
    content = pack(b'{"type":"user/message","seq":1,"time":2,"data":{"a":1}}\nnoise\n') + b"\x28\xb5\x2f\xfdbroken" + pack(b'{"type":"turn/end","seq":2}\n{bad\n')
    (tmp_path / "session.1.zstd").write_bytes(content)
    (tmp_path / "other.zstd").write_bytes(content)
    found = logs.log_files(spark, str(tmp_path))
    assert found.count() == 1
    got = logs.parse_events(logs.log_lines(found)).orderBy("seq").collect()
    assert [(r["type"], r["seq"], r["data"]) for r in got] == [("user/message", 1, '{"a":1}'), ("turn/end", 2, None)]


def test_streamed_turns_equal_a_batch(spark, tmp_path):
    e = events(spark, SF)
    e.repartition(2, "sessionId").sortWithinPartitions("sessionId", "seq").write.parquet(str(tmp_path / "in"))
    run = streams.turns(spark.readStream.schema(EVENT_DDL).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = {(r["sessionId"], r["turn"]): r["n_messages"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want, held, turn = {}, {}, {}
    for r in sorted(e.collect(), key=lambda r: (r["sessionId"], r["seq"])):
        s = r["sessionId"]
        if r["type"] == "user/message":
            held[s] = held.get(s, 0) + 1
        elif r["type"] == "turn/end":
            turn[s] = turn.get(s, 0) + 1
            want[s, turn[s]] = held.pop(s, 0)
    assert got == want and got


def test_quotas_count_what_they_accept(spark):
    data = [("u", f"{i:03d}", f"h{i % 30}", i * 60_000) for i in range(60)]
    got = {r["id"]: r["reason"] for r in streams.batch_quotas(spark.createDataFrame(data, "key string, id string, hash string, at bigint"), per_hour=20).collect()}
    assert [got[f"{i:03d}"] for i in (0, 19, 20, 59)] == [None, None, "over-hour-quota", "over-hour-quota"]


def test_documents_envelopes_and_branches(spark, rows, tmp_path):
    r = rows(dict(id="a", kind="semantic", text="one", tags=["x"]), dict(id="b", kind="episodic", text="two"))
    files.write_documents(r, str(tmp_path / "d"))
    (tmp_path / "d" / "broken.json").write_text("{not json")
    again = files.read_documents(spark, str(tmp_path / "d"))
    assert {(x["id"], x["text"], tuple(x["tags"])) for x in again.collect()} == {("a", "one", ("x",)), ("b", "two", ())}
    (tmp_path / "one.json").write_text('{"schemaVersion": 1, "items": [{"id": "k", "kind": "semantic", "text": "t"}]}')
    (tmp_path / "bare.json").write_text('[{"id": "k", "kind": "semantic", "text": "t"}]')
    assert files.read_envelope(spark, str(tmp_path / "one.json")).count() == 1
    assert files.read_envelope(spark, str(tmp_path / "bare.json")).count() == 0
    git = tmp_path / "tree" / ".git"
    git.mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/feature/x\n")
    assert logs.current_branch(spark, str(git)) == "feature/x"
    (git / "HEAD").write_text("ref: refs/heads/other\n")
    assert logs.current_branch(spark, str(git)) == "feature/x" and logs.read_branch(spark, str(git)) == "other"  # remembered for some seconds
    (tmp_path / "linked").write_text(f"gitdir: {git}\n")
    assert logs.read_branch(spark, str(tmp_path / "linked")) == "other" and logs.read_branch(spark, str(tmp_path / "nowhere")) is None
    catalog = spark.createDataFrame([("s1", "/w", 1, None, None, False, True), ("s2", "/w", 3, None, "p", False, True), ("s3", "/v", 2, None, None, False, True)], "sessionId string, cwd string, createdAt bigint, origin string, parentSession string, live boolean, persisted boolean")
    assert [x["sessionId"] for x in logs.newest(catalog, 5).collect()] == ["s3", "s1"]
    assert [x["sessionId"] for x in logs.newest(catalog, 5, "/w").collect()] == ["s1"] and logs.newest(catalog, 5, "/none").count() == 2
