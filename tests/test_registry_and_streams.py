"""Refs, loops, back-off and budgets as streams in several batches against their batch forms; folds against plain loops; stored tables."""

from __future__ import annotations

import random
import uuid
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.operators import lanes as N
from pagelens.operators import logs as G
from pagelens.operators import monitor as M
from pagelens.operators import refs as R
from pagelens.sources.audit import AuditLog
from pagelens.streaming import run as RUN
from pagelens.streaming import stateful as K

T0 = datetime(2024, 1, 1)
ANCHOR = "struct<page_key:string,role:string,name:string,landmark:string,landmark_label:string,labelled_ancestor:string,attr_id:string,attr_testid:string,attr_name:string>"


def in_batches(spark, tmp_path, df, make, cut, n=3):
    """All that a stream gives for the rows of ``df`` in ``n`` batches, cut at values of ``cut``; and its checkpoint."""
    rows = df.withColumn("__part", F.ntile(n).over(W.orderBy(cut)))
    for k in range(1, n + 1):
        rows.where(F.col("__part") == k).drop("__part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = make(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    spark.conf.set(RUN.PROVIDER, RUN.ROCKSDB)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(RUN.PROVIDER)
    return spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")


def units(spark, seed=1, n=240):
    rng = random.Random(seed)
    some = lambda p, *v: rng.choice(v) if rng.random() < p else None
    rows = []
    for k in range(n):
        anchor = ("p", rng.choice(["link", "button"]), some(0.9, *"abcdef"), "main", "", some(0.3, "x", "y"), some(0.3, "i1", "i2", "i3"), some(0.3, "t1", "t2", "t3"), some(0.2, "n1", "n2"))
        rows.append((rng.choice(["h1", "h2"]), rng.choice([None, "inner"]), rng.choice(["link", "control"]), 1 + k * 6 // n, k, anchor))
    return spark.createDataFrame(rows, f"handle string, frame string, kind string, token long, ord long, anchor {ANCHOR}")


def test_refs_over_six_reads(spark, tmp_path):
    """The stream binds as the batch does; refs are used once in a read; what nothing tells apart is turn-local."""
    u = units(spark)
    batch = R.bind_reads(u)
    rows = batch.collect()
    assert len(rows) == 240 and any(r.turn_local for r in rows) and any(not r.minted for r in rows)
    assert batch.groupBy(*R.SCOPE, "token", "ref").count().where("count > 1").count() == 0
    assert batch.where("turn_local and not minted").count() == 0
    reads = R.reads_of(u)
    got = in_batches(spark, tmp_path, reads, K.bind_reads_stream, "token")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows))


def test_a_weaker_key_finds_the_ref_again(spark):
    """A unit that loses its id keeps its ref by role and name, and the id, when it comes back, still stands for it."""
    a = lambda name, attr_id: ("p", "link", name, "main", "", None, attr_id, None, None)
    rows = [("h", "", "link", 1, 1, a("a", "i")), ("h", "", "link", 2, 1, a("a", None)), ("h", "", "link", 3, 1, a("b", "i")), ("h", "", "link", 3, 2, a("a", None)), ("h", "", "link", 4, 1, a("c", None)), ("h", "", "link", 4, 2, a("c", None))]
    u = spark.createDataFrame(rows, f"handle string, frame string, kind string, token long, ord long, anchor {ANCHOR}")
    bound = R.bind_reads(u)
    got = {(r.token, r.ord): (r.ref, r.key_kind, r.minted) for r in bound.collect()}
    assert got == {(1, 1): (1, "id", True), (2, 1): (1, "role-name-landmark", False), (3, 1): (1, "id", False), (3, 2): (2, "role-name-landmark", True), (4, 1): (3, "turn-local", True), (4, 2): (4, "turn-local", True)}
    entries = {r.ref: r for r in R.ref_entries(bound, u).collect()}
    assert [entries[k].gone for k in (1, 2, 3, 4)] == [True, True, False, False] and entries[1].gone_as == 'link "b"'
    scoped = R.ref_entries(bound, u, F.col("token") == 4).collect()
    assert not any(r.gone for r in scoped)


def test_frames_that_left_their_page(spark):
    a = ("p", "link", "a", "main", "", None, None, None, None)
    u = spark.createDataFrame([("h", f, "link", 1, 1, a) for f in ("", "f1", "f2")], f"handle string, frame string, kind string, token long, ord long, anchor {ANCHOR}")
    live = spark.createDataFrame([("h", "f2")], "handle string, frame string")
    got = {r.frame: r.gone_as for r in R.frames_gone(R.ref_entries(R.bind_reads(u), u), live, "removed").collect()}
    assert got == {"": None, "f1": 'link "a" (in f1, removed)', "f2": None}


def test_loops_across_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k % 2, k, rng.choice("abcdefgh") if k < 60 else "ab"[k // 2 % 2] if k < 80 else rng.choice("abcd")) for k in range(120)]
    df = spark.createDataFrame(rows, "session long, seq long, sig string")
    got = in_batches(spark, tmp_path, df, K.loop_detect_stream, "seq", 5)
    want = G.loop_detect(df).select("session", "seq", "sig", "loop")
    assert {r.loop for r in want.collect()} == {None, "repeat", "alternation"}
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_backoff_across_batches_and_its_end(spark, tmp_path):
    """Waits hold across batches; once event time has passed them, nothing is stored any more."""
    rng = random.Random(3)
    rows = [(f"d{rng.randrange(3)}", T0 + timedelta(seconds=20 * k), k, rng.choice([200, 429, 503]), rng.choice([None, 0.0, 30.0, 200.0])) for k in range(90)]
    rows += [("last", T0 + timedelta(days=2, seconds=k), 100 + k, 200, None) for k in range(2)]
    df = spark.createDataFrame(rows, "domain string, ts timestamp, seq long, status int, wait double")
    got = in_batches(spark, tmp_path, df, lambda s: K.backoff_stream(s, watermark="1 minute"), "ts", 4)
    want = G.backoff_windows(df).select("domain", "seq", "refused", "owner_status")
    assert want.where("refused").count() > 10
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    kept = spark.read.format("statestore").option("stateVarName", "open").load(f"{tmp_path}/check")
    assert kept.count() == 0


def test_full_budget_across_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k % 3, k, T0 + timedelta(seconds=40 * k), rng.choice(["navigation", "download", "other"]), rng.choice([None, "o1", "o2", "o3", "o4"])) for k in range(150)]
    df = spark.createDataFrame(rows, "session long, seq long, ts timestamp, kind string, origin string")
    limits = {"action": 22, "navigation": 12, "download": 6, "new_origin": 3}
    got = in_batches(spark, tmp_path, df, lambda s: K.charge_calls_stream(s, limits, 4000), "seq", 4)
    want = G.charge_budget(df, limits, 4000)
    assert len({r.refused for r in want.collect()}) >= 5
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def lanes_by_hand(rows):
    out = {}
    for host, lane, outcome, day, seq, vendor, wall in sorted(rows, key=lambda r: (r[3], r[4])):
        n, last_ok, last_bad, v, w, last = out.get((host, lane), ({"ok": 0, "blocked": 0, "dropped": 0}, None, None, None, None, None))
        latest = max([x for x in (last_ok, last_bad) if x], default=None)
        if latest and (day - latest).days > 30:
            n = {k: x // 2 for k, x in n.items()}
        n = {**n, outcome: n[outcome] + 1}
        if outcome == "ok":
            last_ok = max(last_ok or day, day)
        else:
            last_bad = max(last_bad or day, day)
        out[host, lane] = (n, last_ok, last_bad, vendor or v, wall or w, "ok" if outcome == "ok" else "bad")
    return {k: (n["ok"], n["blocked"], n["dropped"], last, a, b, v, w) for k, (n, a, b, v, w, last) in out.items()}


def test_lane_records_in_one_go_and_in_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice(["x", "y"]), rng.choice(N.OUTCOMES), date(2024, 1, 1) + timedelta(days=rng.randrange(400)), k, rng.choice([None, "V", "U"]), rng.choice([None, "captcha"])) for k in range(120)]
    df = spark.createDataFrame(rows, "host string, lane string, outcome string, day date, seq long, vendor string, wall string")
    want = lanes_by_hand(rows)
    found = lambda d: {(r.host, r.lane): tuple(r)[2:] for r in d.collect()}
    assert found(N.record_outcomes(df)) == want
    table = RUN.VersionedTable(spark, f"{tmp_path}/lanes")
    cuts = [date(2024, 1, 1), date(2024, 3, 15), date(2024, 9, 1), date(2026, 1, 1)]
    for k in range(3):
        assert table.fold(df.where((F.col("day") >= cuts[k]) & (F.col("day") < cuts[k + 1])), k, N.record_outcomes)
    assert found(table.read()) == want
    assert not table.fold(df, 2, N.record_outcomes) and not table.fold(df, 1, N.record_outcomes)
    assert found(table.read()) == want and table.versions() == [1, 2]


def monitors_by_hand(rows):
    out = {}
    for m, at, _, ok, blocked, until in sorted(rows, key=lambda r: (r[1], r[2])):
        s = out.setdefault(m, {"failures": 0, "paused": False, "checks": 0, "last_attempt": None, "last_ok": None, "last_failed": False, "blocked_until": None})
        if s["paused"]:
            continue
        s["checks"], s["last_attempt"] = s["checks"] + 1, at
        if ok:
            s.update(failures=0, last_ok=at, last_failed=False)
        elif blocked:
            s["blocked_until"] = until
        else:
            s.update(failures=s["failures"] + 1, last_failed=True)
            s["paused"] = s["failures"] >= 6
    return {m: tuple(s.values()) for m, s in out.items()}


@pytest.mark.parametrize("seed", [6, 7, 8])
def test_monitor_states_in_one_go_and_in_batches(spark, tmp_path, seed):
    """Runs of failures within a day, over the end of a day and over batches pause at the sixth; blocked checks neither count nor part a run."""
    rng = random.Random(seed)
    rows = []
    for m in range(12):
        for k in range(60):
            ok, blocked = rng.random() < 0.05 * m, rng.random() < 0.2
            at = 7200.0 * k + m
            rows.append((m, at, k, ok, blocked and not ok, at + 900 if blocked and not ok else None))
    df = spark.createDataFrame(rows, "monitor_id int, at double, seq long, ok boolean, blocked boolean, blocked_until double")
    want = monitors_by_hand(rows)
    assert 1 < sum(s[1] for s in want.values()) < 12
    found = lambda d: {r.monitor_id: tuple(r)[1:] for r in d.collect()}
    assert found(M.monitor_state(df)) == want
    table = RUN.VersionedTable(spark, f"{tmp_path}/monitors")
    for k, part in enumerate((F.col("at") < 50_000, F.col("at").between(50_000, 300_000), F.col("at") > 300_000)):
        table.fold(df.where(part), k, M.monitor_state)
    assert found(table.read()) == want
    ages = M.check_history(df, 3).where("monitor_id = 1").orderBy("age").select("seq").collect()
    assert [r.seq for r in ages] == [59, 58, 57]


def test_stream_folds_into_a_table(spark, tmp_path):
    rows = [("h", "l", "ok", date(2024, 1, 1) + timedelta(days=k), k, None, None) for k in range(9)]
    schema = "host string, lane string, outcome string, day date, seq long, vendor string, wall string"
    for k in range(3):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for check in ("one", "one", "two"):  # a new start finds nothing new; a lost checkpoint repeats batches, which count once
        RUN.fold_into(stream(), f"{tmp_path}/out", N.record_outcomes, f"{tmp_path}/{check}").trigger(availableNow=True).start().awaitTermination()
        assert RUN.VersionedTable(spark, f"{tmp_path}/out").read().first().ok == 9


def audit(spark, seqs):
    return spark.createDataFrame([(k, "t", f"tool{k % 3}") for k in seqs], "seq long, ts string, tool string")


def test_audit_rotation_and_appends_meanwhile(spark, tmp_path):
    log = AuditLog(spark, f"file://{tmp_path}/audit")
    assert log.read().count() == 0 and not log.rotate(10)["rotated"]
    log.append(audit(spark, range(15)))
    assert not log.rotate(10)["rotated"]
    log.append(audit(spark, range(15, 30)))
    late = AuditLog(spark, f"file://{tmp_path}/audit")
    listed = late.appended

    def append_after_listing():
        names = listed()
        if late is not None and not appended:
            appended.append(True)
            log.append(audit(spark, range(30, 34)))  # arrives between the listing and the manifest
        return names

    appended: list[bool] = []
    late.appended = append_after_listing
    receipt = late.rotate(10)
    late.appended = listed
    assert receipt["rotated"] and receipt["dropped"] == 20
    assert sorted(r.seq for r in log.read().collect()) == list(range(20, 34))
    assert log.rotate(5)["dropped"] == 29 and sorted(r.seq for r in log.read().collect()) == list(range(29, 34))
    log.append(audit(spark, [34]))
    assert sorted(r.seq for r in log.read().collect()) == list(range(29, 35))


def test_of_two_rotations_one_counts(spark, tmp_path):
    path = f"file://{tmp_path}/audit-{uuid.uuid4().hex}"
    one, two = AuditLog(spark, path), AuditLog(spark, path)
    one.append(audit(spark, range(30)))
    before = two.manifest()
    assert one.rotate(10)["rotated"]
    calls = [before]
    current = two.manifest
    two.manifest = lambda: calls.pop() if calls else current()  # it looked before the other was done
    assert not two.rotate(10)["rotated"]
    two.manifest = current
    assert sorted(r.seq for r in two.read().collect()) == list(range(20, 30)) and two.manifest()["dropped"] == 20
