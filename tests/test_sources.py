import json
import os

import pytest

from corpusloom.schema import RECORD
from corpusloom.sources import corpora, pending
from corpusloom.streaming import ingest


def record(i, proof="p", **kw):
    return {"id": i, "arm": "extreme", "proof": proof, "usage": {"input_tokens": 1, "output_tokens": 2}} | kw


def lines(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows))


def frame(spark, rows):
    return spark.read.schema(RECORD).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def test_scan(spark, tmp_path):
    lines(f"{tmp_path}/a/x.jsonl", [record("1", "äö🙂"), "", "   ", record("2", ""), record("3", None, unknown=5), "{broken"])
    got = {r["id"]: (r["chars"], r["log_chars"]) for r in corpora.read_jsonl(spark, f"{tmp_path}/a/x.jsonl").collect()}
    assert got["1"][0] == 3 and got["2"] == (0, None) and got["3"] == (None, None)
    assert None in got and len(got) == 4


def test_append_new_is_idempotent(spark, tmp_path):
    path = f"{tmp_path}/c.jsonl"
    for _ in range(2):
        corpora.append_new(frame(spark, [record("1"), record("2"), record("2", "again")]), path)
    assert sorted(r["id"] for r in corpora.read_jsonl(spark, path).collect()) == ["1", "2"]


def test_rewrite_keeps_the_old_version(spark, tmp_path):
    path = f"{tmp_path}/c.jsonl"
    corpora.append_jsonl(frame(spark, [record("1"), record("2")]), path)
    new = corpora.rewrite_jsonl(corpora.read_jsonl(spark, path).where("id = '1'"), path, "1")
    assert corpora.read_jsonl(spark, path).count() == 2 and corpora.read_jsonl(spark, new).count() == 1
    with pytest.raises(Exception, match="already exists"):
        corpora.rewrite_jsonl(corpora.read_jsonl(spark, path), path, "1")


def test_masked_is_written_once(spark, tmp_path):
    path = f"{tmp_path}/c.jsonl"
    out = corpora.write_masked(frame(spark, [record("1")]), path)
    assert out.endswith("c.masked.jsonl")
    corpora.write_masked(frame(spark, [record("2"), record("3")]), path)
    assert [r["id"] for r in corpora.read_jsonl(spark, out).collect()] == ["1"]


def test_cache_checks_rows(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = f"{tmp_path}/v.parquet"
    assert corpora.cached(spark, path, 3, build).count() == 3
    corpora.cached(spark, path, 3, build)
    assert len(calls) == 1
    corpora.cached(spark, path, 4, build)
    assert len(calls) == 2
    assert corpora.cache_path("/x/proofs_a.b.jsonl") == "a_b.vectors.parquet"


def test_align(spark):
    c = spark.createDataFrame([(1,), (2,)], "line_no long")
    v = spark.createDataFrame([(1, [1.0])], "vec_id long, vec array<double>")
    with pytest.raises(Exception, match="no vector"):
        corpora.align(c, v, "line_no", "vec_id").collect()
    assert corpora.align(c.where("line_no = 1"), v, "line_no", "vec_id").count() == 1


def test_pending(spark, tmp_path):
    lines(f"{tmp_path}/p/a.json", [{"x1": {"arm": "extreme", "language": "en"}, "t1": {"arm": "technique"}}])
    got = pending.read_pending(spark, f"{tmp_path}/p/a.json")
    assert {(r["id"], r["arm"]) for r in got.collect()} == {("x1", "extreme"), ("t1", "technique")}
    pending.write_pending(got.coalesce(1), f"{tmp_path}/q")
    assert {(r["id"], r["arm"]) for r in pending.read_pending(spark, f"{tmp_path}/q").collect()} == {("x1", "extreme"), ("t1", "technique")}
    df = spark.createDataFrame([("a", '{"arm": "scope"}'), ("b", "{}"), ("c", None), ("a", '{"arm": "scope"}')], "id string, meta string")
    assert {(r["arm"], r["rows"], r["ids"]) for r in pending.describe_pending(df).collect()} == {("scope", 2, 1), (None, 2, 2)}


class Provider:
    def __init__(self, n=2):
        self.n = n

    def parts(self, batch):
        return [f"{batch}-{k}" for k in range(self.n)]

    def results(self, batch, part):
        yield {"custom_id": part, "content": [("text", "ok")], "stop_reason": "end_turn", "input_tokens": 1, "output_tokens": 2}
        yield {"custom_id": part + "-e", "stop_reason": "error"}


def test_batch_source(spark):
    spark.dataSource.register(pending.BatchResults)
    import sys

    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    spark.sparkContext.addPyFile(os.path.join(here, "test_sources.py"))
    df = spark.read.format("corpusloom_batch").options(provider="test_sources:Provider", batch="b", arguments='{"n": 3}').load()
    got = df.collect()
    assert len(got) == 6 and {r["stop_reason"] for r in got} == {"end_turn", "error"}


def test_stream_goes_on_after_restart(spark, tmp_path):
    base = str(tmp_path)
    lines(f"{base}/in/a.jsonl", [record("1"), record("2"), record("1", "again")])

    def run():
        q = ingest.ingest(ingest.arriving(spark, f"{base}/in"), f"{base}/out", f"{base}/state")
        q.awaitTermination()

    run()
    lines(f"{base}/in/b.jsonl", [record("2"), record("3"), {"arm": "no id"}])
    run()
    assert sorted(r["id"] for r in corpora.read_jsonl(spark, f"{base}/out").collect()) == ["1", "2", "3"]


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    import shutil

    base = str(tmp_path)
    lines(f"{base}/in/a.jsonl", [record("1"), record("2")])
    for _ in range(2):
        ingest.ingest(ingest.arriving(spark, f"{base}/in"), f"{base}/out", f"{base}/state").awaitTermination()
        shutil.rmtree(f"{base}/state")  # the batch's commit is lost
    assert sorted(r["id"] for r in corpora.read_jsonl(spark, f"{base}/out").collect()) == ["1", "2"]


def test_submit_poll_collect(spark, tmp_path):
    base = str(tmp_path)
    service = pending.FolderService(f"{base}/service")
    grid = spark.createDataFrame([("x__d__en__0", "extreme", "ask"), ("s__c__en__0", "scope", "tell me")], "id string, arm string, prompt string")
    batch = pending.submit(grid, service, base, "m", 10)
    with pytest.raises(ValueError, match="not collected"):
        pending.submit(grid, service, base, "m", 10)
    assert pending.poll(service, batch)["state"] == "ended"
    got = {r["id"]: (r["arm"], r["proof"]) for r in pending.collect(spark, base, "corpusloom.sources.pending:FolderService", {"root": f"{base}/service"}, f"{base}/c.jsonl").collect()}
    assert got == {"x__d__en__0": ("extreme", "ask"), "s__c__en__0": ("scope", "tell me")}
    pending.submit(grid, service, base, "m", 10)  # collected, so a new one may go

    class Slow:
        def status(self, batch):
            return {"state": "processing"}

    with pytest.raises(TimeoutError):
        pending.poll(Slow(), "b", 0, 3)


def test_stored_tables_are_dropped(spark):
    from corpusloom import session

    first = session.stored(spark.range(3))
    second = session.stored(first.selectExpr("id + 1 AS id"), first)
    assert not os.path.exists(first.stored_in) and sorted(r["id"] for r in second.collect()) == [1, 2, 3]
    assert session.stored(spark.range(0)).count() == 0
    session._drop_all()
    assert not os.path.exists(second.stored_in) and not session._STORED
