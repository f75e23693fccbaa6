"""Dimension defaults, registry catalog, client address, streaming dedup/upsert/late join."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from veilmark.functions import rules as R
from veilmark.operators import audit as AU
from veilmark.operators import vault as VT
from veilmark.streaming import audit_stream as ST


def test_type_dims_defaults(spark):
    df = spark.createDataFrame([("REGON",), ("KRS",), ("PERSON",), ("FINANCE",), ("NRP",)], "t string")
    rows = df.select("t", R.type_label(F.col("t")).alias("l"), R.type_severity(F.col("t")).alias("s"),
                     R.token_prefix(F.col("t")).alias("p"), R.type_remap(F.col("t")).alias("r")).collect()
    got = {r.t: (r.l, r.s, r.p, r.r) for r in rows}
    assert got["REGON"] == ("REGON", "info", "REGON", "REGON")
    assert got["PERSON"] == ("Full Name", "critical", "OSOBA", "PERSON")
    assert got["FINANCE"] == ("Financial Amount", "warning", "FINANCE", "FINANCE")
    assert got["NRP"][3] == "PESEL" and got["NRP"][2] == "PESEL"


def test_provider_catalog_and_models(spark):
    conf = spark.createDataFrame([("claude", "k"), ("openai", " "), ("gemini", None)], "provider string, api_key string")
    cat = {r.provider: r for r in R.provider_catalog(spark, conf).collect()}
    assert cat["claude"].configured and cat["ollama"].configured and not cat["openai"].configured
    assert cat["claude"].default_model == "claude-sonnet-4-6-20260217"
    assert len(cat["gemini"].models) == 6
    df = spark.createDataFrame([("claude", ""), ("openai", "gpt-5-mini"), ("nope", None)], "p string, m string")
    assert [r.x for r in df.select(AU.resolve_model(F.col("p"), F.col("m")).alias("x")).collect()] == [
        "claude-sonnet-4-6-20260217", "gpt-5-mini", ""]


def test_client_ip(spark):
    df = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8", "9.9.9.9"), (None, "9.9.9.9"), (None, None)], "x string, p string")
    assert [r.ip for r in df.select(AU.client_ip(F.col("x"), F.col("p")).alias("ip")).collect()] == [
        "1.2.3.4", "9.9.9.9", "unknown"]


def test_stream_dedup_and_upsert(spark):
    d = tempfile.mkdtemp(prefix="veilmark-stream-", dir="/tmp")
    t0 = dt.datetime(2026, 1, 1, 10, 0, 0)
    rows = [(1, t0, "file_uploaded", "s1"), (1, t0, "file_uploaded", "s1"), (2, t0 + dt.timedelta(minutes=1), "task_created", "s1"),
            (3, t0 + dt.timedelta(minutes=2), "task_created", "s2")]
    spark.createDataFrame(rows, "event_id long, timestamp timestamp, event string, session_id string").write.json(
        os.path.join(d, "in"))
    s = ST.audit_stream(spark, os.path.join(d, "in"))
    q = (ST.dedup_events(s).writeStream.foreachBatch(ST.upsert_batch(os.path.join(d, "out"), "session_id", "event_id"))
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    out = VT.upsert_latest(spark.read.parquet(os.path.join(d, "out")).drop("_batch_id"), "session_id", "event_id")
    assert {r.session_id: r.event_id for r in out.collect()} == {"s1": 2, "s2": 3}


def test_late_deep_results_batch(spark):
    t0 = dt.datetime(2026, 1, 1, 10, 0, 0)
    files = spark.createDataFrame([(1, t0), (2, t0)], "doc_id long, uploaded_at timestamp")
    deep = spark.createDataFrame([(1, t0 + dt.timedelta(minutes=2)), (2, t0 + dt.timedelta(minutes=30))],
                                 "doc_id long, done_at timestamp")
    j = ST.late_deep_results(files, deep).select(F.col("f.doc_id").alias("id"), F.col("d.done_at").isNotNull().alias("hit"))
    assert {r.id: r.hit for r in j.collect()} == {1: True, 2: False}


def test_result_text_and_lists(spark):
    from veilmark.operators import conversations as CV

    a = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", "<ROZWIAZANIE>s1</ROZWIAZANIE>"), (1, 3, "assistant", " plain "),
         (2, 0, "user", "<ROZWIAZANIE>no</ROZWIAZANIE>"), (3, 1, "assistant", " x "),
         (4, 1, "assistant", "<ROZWIAZANIE>a</ROZWIAZANIE>"), (4, 2, "assistant", "<ROZWIAZANIE> b </ROZWIAZANIE>"), (5, 1, "assistant", "<ROZWIAZANIE> </ROZWIAZANIE>")],
        "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.solution_text, r.result_text) for r in CV.result_text(a).collect()}
    assert got == {1: ("s1", "s1"), 2: (None, ""), 3: (None, "x"), 4: ("b", "b"), 5: ("", "<ROZWIAZANIE> </ROZWIAZANIE>")}
    t0 = dt.datetime(2026, 1, 1)
    summary = spark.createDataFrame([(i, f"t{i}", t) for i, t in enumerate([t0, t0 + dt.timedelta(1), None, t0])], "task_id long, title string, last_activity_at timestamp")
    owners = spark.createDataFrame([("u", 0), ("u", 1), ("u", 2), ("v", 3), ("w", 9)], "owner string, task_id long")
    assert sorted((r.owner, r.rank, r.task_id) for r in CV.conv_list(summary, owners).collect()) == [("u", 1, 1), ("u", 2, 0), ("u", 3, 2), ("v", 1, 3)]


def test_expired_contexts_lose_their_vault_rows(spark):
    now = dt.datetime(2026, 4, 23, 12, 0, 0)
    tasks = spark.createDataFrame([("a", now - dt.timedelta(hours=2), None), ("b", now - dt.timedelta(hours=2), now), ("c", None, None)],
                                  "task_id string, created_at timestamp, last_activity_at timestamp")
    v = spark.createDataFrame([(s, "[X_aaaa]", s) for s in "abcd"], "session_id string, token string, value string")
    kept, flagged = VT.erase_expired_contexts(v, tasks, "2026-04-23 12:00:00", 3600)
    assert sorted(r.session_id for r in kept.collect()) == ["b", "c", "d"]
    assert {r.task_id: r.context_expired for r in flagged.collect()} == {"a": True, "b": False, "c": False}


def test_ownership_fallback_chain(spark):
    from veilmark.operators import conversations as CV

    recs = spark.createDataFrame(
        [("t1", "u1", "alice", None), ("t2", " ", "bob", None), ("t3", None, None, "carol"), ("t4", None, "", None)],
        "task_id string, user_id string, username string, user string")
    ids = spark.createDataFrame([("u1", "zed"), ("u2", "bob"), ("u3", "carol"), ("anonymous", "anonymous")],
                                "ident_user_id string, ident_username string")
    got = {(r.ident_user_id, r.task_id) for r in CV.owned(recs, ids, legacy_user="user").collect()}
    assert got == {("u1", "t1"), ("u2", "t2"), ("u3", "t3"), ("anonymous", "t4")}
