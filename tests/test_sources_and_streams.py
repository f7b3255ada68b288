import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sealmark.sources import commits, ledger, segments
from sealmark.streaming import state


def test_missing_store_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        ledger.read(spark, str(tmp_path), "task")


def test_older_store_gets_defaults(spark, tmp_path):
    old = spark.createDataFrame([(1, "c", "k", "w", "y", 1, "r", "d")], "id long, claim_id string, kind string, who string, why string, was_tty int, git_record string, subject_digest string").withColumn("created_at", F.current_timestamp())
    old.write.parquet(f"{tmp_path}/accepted_risk")
    row = ledger.read(spark, str(tmp_path), "accepted_risk").first()
    assert (row.scope, row.cover_key, row.signed_by) == ("task", "", "")


def test_append_refuses_unknown_words_and_known_keys(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "token = abcdefgh"), (2, "b", ""), (3, "nope", "")], "id long, kind string, note string")
    bad = ledger.append(rows, str(tmp_path), "event", key="id", vocabularies={"kind": ["a", "b"]}, free_text=("note",))
    assert [r.id for r in bad.collect()] == [3]
    ledger.append(rows.filter("id < 3").withColumn("note", F.lit("again")), str(tmp_path), "event", key="id")
    got = {r.id: r.note for r in spark.read.parquet(f"{tmp_path}/event").collect()}
    assert got == {1: "token = [REDACTED]", 2: ""}


def test_free_text_of_each_table_is_redacted_on_write_and_on_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, "why token = abcdefgh", "secret: abcdefgh1")], "id long, why string, kind string")
    ledger.append(rows, str(tmp_path), "accepted_risk")
    stored = spark.read.parquet(f"{tmp_path}/accepted_risk")
    assert tuple(stored.first())[1:] == ("why token = [REDACTED]", "secret: abcdefgh1")
    lines = [json.loads(r.value) for r in ledger.to_lines({"accepted_risk": rows, "other": rows}).collect()]
    assert [(x["_table"], x["why"], x.get("_redacted")) for x in sorted(lines, key=lambda x: x["_table"])] == [("accepted_risk", "why token = [REDACTED]", ["why"]), ("other", "why token = abcdefgh", None)]


def exported(path):
    """Segments as lists of lines, by number, from the files that the manifests name."""
    seqs = {}
    for m in sorted(path.glob("manifest/epoch=*/part-*")):
        for line in m.read_text().splitlines():
            seqs[json.loads(line)["seq"]] = int(m.parent.name.split("=")[1])
    out = {}
    for seq, epoch in sorted(seqs.items()):
        (file,) = (path / "rows" / f"epoch={epoch}" / f"seq={seq}").glob("part-*")
        out[seq] = [json.loads(x) for x in file.read_text().splitlines()]
    return out


def ledger_rows(spark, n, extra=0):
    e = spark.createDataFrame([(i, f"k{i}", f"h{i}") for i in range(1, n + 1 + extra)], "id long, kind string, row_hash string")
    a = spark.createDataFrame([(i, "z" * (i % 3) * 40, f"a{i}") for i in range(1, 6 + extra)], "id long, kind string, row_hash string")
    return {"attempt": a.repartition(3), "event": e.repartition(3)}


def test_export_is_in_order_and_sealed_by_size(spark, tmp_path):
    at = tmp_path / "x"
    segments.export(ledger_rows(spark, 22), str(at), seal_bytes=200)
    got = exported(at)
    data = [x for s in got.values() for x in s if x["_table"] not in ("_segment", "_anchor")]
    assert [(x["_table"], x["id"]) for x in data] == [("attempt", i) for i in range(1, 6)] + [("event", i) for i in range(1, 23)]
    assert list(got) == list(range(1, len(got) + 1)) and len(got) > 4
    before, head = {"attempt": 0, "event": 0}, ""
    for seq, lines in got.items():
        if seq > 1:
            assert (lines[0]["_table"], lines[0]["skip"], lines[0]["starts_after"]) == ("_segment", before, head)
        rows = [x for x in lines if x["_table"] in before]
        sizes = [len(json.dumps(x, separators=(",", ":"))) + 1 for x in rows]
        assert sum(sizes[:-1]) <= 200  # over the bound by less than a row
        for x in rows:
            before[x["_table"]] += 1
            head = x["row_hash"] if x["_table"] == "attempt" else head
    assert got[len(got)][-1] == {"_table": "_anchor", "rows": before, "head_hash": "a5"}
    assert segments.faults(spark, str(at)).count() == 0
    lines = segments.read(spark, str(at)).withColumnRenamed("seq", "file").withColumn("file", F.col("file").cast("string"))
    assert ledger.line_faults(lines.filter("NOT startswith(value, '{\"_table\":\"_')"), ["attempt", "event"]).count() == 0


def test_later_exports_write_what_is_new(spark, tmp_path):
    at = tmp_path / "x"
    segments.export(ledger_rows(spark, 8), str(at), seal_bytes=150)
    first = exported(at)
    segments.export(ledger_rows(spark, 8, extra=9), str(at), seal_bytes=150)
    got = exported(at)
    sealed = [s for s in first if s < max(first)]
    assert all(got[s] == first[s] for s in sealed)
    data = sorted((x["_table"], x["id"]) for s in got.values() for x in s if x["_table"] in ("attempt", "event"))
    assert data == [("attempt", i) for i in range(1, 15)] + [("event", i) for i in range(1, 18)]
    assert segments.faults(spark, str(at)).count() == 0
    with pytest.raises(segments.LostRows):
        t = ledger_rows(spark, 8, extra=9)
        segments.export({**t, "attempt": t["attempt"].filter("id != 1")}, str(at), seal_bytes=150)


def test_an_export_that_dies_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    at = tmp_path / "x"
    segments.export(ledger_rows(spark, 8), str(at), seal_bytes=150)
    before = sorted(r.value for r in segments.read(spark, str(at)).collect())
    (at / "rows" / "epoch=2" / "seq=9").mkdir(parents=True)  # rows without a manifest
    (at / "rows" / "epoch=2" / "seq=9" / "part-0.txt").write_text('{"_table":"event","id":99}\n')
    assert sorted(r.value for r in segments.read(spark, str(at)).collect()) == before
    segments.export(ledger_rows(spark, 9), str(at), seal_bytes=150)
    assert segments.read(spark, str(at)).filter(F.contains("value", F.lit('"id":99'))).count() == 0


def test_many_small_segments_share_files(spark, tmp_path, monkeypatch):
    one, many = tmp_path / "one", tmp_path / "many"
    segments.export(ledger_rows(spark, 8), str(one), seal_bytes=150)
    segments.export(ledger_rows(spark, 40, extra=9), str(one), seal_bytes=150)
    monkeypatch.setattr(segments, "FILES", 2)
    monkeypatch.setattr(segments, "PACK_BYTES", 600)
    segments.export(ledger_rows(spark, 8), str(many), seal_bytes=150)
    (many / "rows" / "epoch=2" / "seq=9").mkdir(parents=True)  # rows without a manifest
    (many / "rows" / "epoch=2" / "seq=9" / "part-0.txt").write_text('{"_table":"event","id":99}\n')
    segments.export(ledger_rows(spark, 40, extra=9), str(many), seal_bytes=150)
    lines = lambda at: sorted(tuple(r) for r in segments.read(spark, str(at)).collect())
    n = segments.manifest(spark, str(many)).count()
    assert lines(many) == lines(one) and n > 12 and segments.faults(spark, str(many)).count() == 0
    assert len(list(many.glob("packs/epoch=*/*/part-*"))) < n / 2 + 2 and not list(many.glob("rows/epoch=1"))


def test_odd_exports(spark, tmp_path):
    t = ledger_rows(spark, 3)
    segments.export({k: v.limit(0) for k, v in t.items()}, str(tmp_path / "none"))
    assert segments.read(spark, str(tmp_path / "none")).count() == 0
    segments.export(t, str(tmp_path / "one"))
    assert list(exported(tmp_path / "one")) == [1] and segments.faults(spark, str(tmp_path / "one")).count() == 0
    long = spark.createDataFrame([(1, "x" * 1000, "h"), (2, "y", "h2"), (3, "z", None)], "id long, kind string, row_hash string")
    segments.export({"attempt": long}, str(tmp_path / "long"), seal_bytes=100)
    assert list(exported(tmp_path / "long")) == [1, 2, 3] and segments.faults(spark, str(tmp_path / "long")).count() == 0


def test_line_faults(spark):
    broken = spark.createDataFrame([("f", "nonsense"), ("f", '{"_table":"who","id":1}'), ("f", '{"_table":"event","id":1}'), ("g", '{"_table":"event","id":1}')], "file string, value string")
    assert sorted(r.problem for r in ledger.line_faults(broken, ["event"]).collect()) == ["not an object", "repeated id", "unknown table"]


def test_facts(spark, tmp_path):
    entry = lambda p, s: {"pattern": p, "seen_at": s, "kind": "call", "match": "symbol", "note": ""}
    path = tmp_path / "facts.json"
    path.write_text(json.dumps({"outbound_write": [entry("a.b", "x.py:3"), entry("", "x.py:4")], "outbound_read": [entry("a.b", "y.py")], "auth_decision": []}))
    rows = ledger.facts(spark, str(path))
    assert rows.count() == 3
    assert sorted(r.problem for r in ledger.facts_faults(rows).collect()) == ["no pattern", "no place", "writes and reads"]


def test_hunks(spark):
    diff = "--- a/f.py\n+++ b/f.py\n@@ -1,2 +1,3 @@\n+x\n@@ -9 +10 @@\n+y\n@@ -20,2 +21,0 @@\n-z\n--- a/g.py\n+++ b/g.py\n@@ -1 +5,2 @@\n"
    got = ledger.hunks(spark.createDataFrame([(diff,)], "value string"))
    assert sorted((r.path, r.line) for r in got.collect()) == [("f.py", 1), ("f.py", 2), ("f.py", 3), ("f.py", 10), ("g.py", 5), ("g.py", 6)]


def test_transition_rules():
    seen: dict[int, str] = {}
    assert state.apply_transition(0, seen, (1, 0, "assign", "a")) == (1, "applied")
    assert state.apply_transition(1, seen, (1, 0, "assign", "a")) == (1, "replayed")
    assert state.apply_transition(1, seen, (1, 0, "assign", "b"))[1].startswith("refused")
    assert state.apply_transition(1, seen, (2, 0, "assign", "c")) == (1, "refused: stale version")
    assert state.apply_transition(1, seen, (3, 0, "result", "d")) == (1, "kept late")
    assert state.apply_transition(1, seen, (2, 1, "assign", "c")) == (2, "applied")


def test_transitions_as_a_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    batches = [[(1, 7, 0, "assign", "a"), (2, 7, 0, "stop", "b")], [(1, 7, 0, "assign", "a"), (3, 7, 0, "result", "c"), (4, 7, 1, "stop", "d")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, state.TRANSITIONS).coalesce(1).write.mode("append").parquet(str(src))
        q = state.transitions(spark.readStream.schema(state.TRANSITIONS).parquet(str(src))).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None, n
    got = sorted((r.id, r.outcome) for r in spark.read.parquet(out).collect())
    assert got == [(1, "applied"), (1, "replayed"), (2, "refused: stale version"), (3, "kept late"), (4, "applied")]


def test_transitions_of_a_table(spark):
    data = [(2, 7, 0, "stop", "b"), (1, 7, 0, "assign", "a"), (1, 7, 0, "assign", "a"), (3, 7, 0, "result", "c"), (4, 7, 1, "stop", "d"), (1, 8, 0, "assign", "a"), (1, None, 1, "assign", "a")]
    got = state.transitions(spark.createDataFrame(data, state.TRANSITIONS)).collect()
    assert sorted((r.id, str(r.key), r.outcome) for r in got) == [(1, "7", "applied"), (1, "7", "replayed"), (1, "8", "applied"), (1, "None", "refused: stale version"), (2, "7", "refused: stale version"), (3, "7", "kept late"), (4, "7", "applied")]
    assert state.transitions(spark.createDataFrame([], state.TRANSITIONS)).count() == 0


def run(q):
    q = q.trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return q


def test_upsert_ignore_is_idempotent(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "claims")
    schema = "id string, sha string"
    for rows in ([("a", "1"), ("b", "1")], [("a", "1"), ("b", "2"), ("c", "1")], [("b", "2")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        run(state.upsert_ignore(spark.readStream.schema(schema).parquet(src), target, "id", "sha", str(tmp_path / "cp")))
    assert sorted(tuple(r) for r in commits.read(spark, target, "rows").collect()) == [("a", "1"), ("b", "1"), ("c", "1")]
    assert sorted(tuple(r) for r in commits.read(spark, target, "raised").collect()) == [("b", "2")]


def test_a_commit_that_dies_between_its_writes_shows_nothing(spark, tmp_path, monkeypatch):
    root, rows = str(tmp_path / "r"), lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    ids = lambda t: sorted(r.id for r in commits.read(spark, root, t).collect())
    assert commits.read(spark, root, "a") is None and not commits.done(spark, root, 0)
    assert commits.commit(root, 0, {"a": rows(1), "b": rows(10)})

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(commits, "_publish", dies)
        with pytest.raises(RuntimeError):
            commits.commit(root, 1, {"a": rows(2), "b": rows(20)})
    assert (ids("a"), ids("b")) == ([1], [10])
    assert commits.commit(root, 1, {"a": rows(2), "b": rows(20)}) and not commits.commit(root, 1, {"a": rows(2), "b": rows(20)})
    assert (ids("a"), ids("b")) == ([1, 2], [10, 20])
    assert commits.commit(root, 2, {"b": rows(30)})
    commits.compact(spark, root, 1)
    assert (ids("a"), ids("b")) == ([1, 2], [10, 20, 30]) and not commits.commit(root, 0, {"a": rows(9)})
    commits.compact(spark, root, 2)
    assert commits.commit(root, 3, {"a": rows(3)}) and (ids("a"), ids("b")) == ([1, 2, 3], [10, 20, 30])


def test_bounded_state_gives_the_same_outcomes_within_the_horizon(spark, tmp_path):
    src, out, n = tmp_path / "in", str(tmp_path / "out"), 24
    every = []
    for i in range(n):
        rows = [(10 * i, 7, i, "assign", "a"), (10 * i, 7, i, "assign", "a"), (10 * i + 1, 7, i, "stop", "b"), (10 * (i - 1), 7, i - 1, "assign", "a" if i % 2 else "z"), (10 * i + 2, 7, i - 1, "result", "c")]
        every += rows if i else rows[:3]
        spark.createDataFrame(rows if i else rows[:3], state.TRANSITIONS).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(state.TRANSITIONS).option("maxFilesPerTrigger", 1).parquet(str(src))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    try:
        q = run(state.bounded_transitions(stream, horizon=8).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["numInputRows"]]
    assert len(sizes) == n and max(sizes) == sizes[-1] == sizes[8]  # ids, places and one value, from the horizon on
    got = sorted((r.id, r.version, r.action, r.outcome) for r in spark.read.parquet(out).collect())
    want, version, seen = [], 0, {}
    for i in range(n):  # batch by batch, as the stream saw them, with all ids kept
        for id_, _, v, action, sha in sorted(every[0:3] if i == 0 else every[3 + 5 * (i - 1) : 3 + 5 * i], key=lambda r: (r[0], r[2])):
            version, outcome = state.apply_transition(version, seen, (id_, v, action, sha))
            want.append((id_, v, action, outcome))
    assert got == sorted(want) and {"applied", "replayed", "kept late"} <= {r[3] for r in got}


def test_rows_before_the_horizon_are_kept_aside(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    for rows in ([(i, 1, i, "assign", "a") for i in range(6)], [(0, 1, 0, "assign", "a"), (5, 1, 5, "assign", "a"), (90, 1, 1, "result", "x"), (91, 1, 5, "result", "x")]):
        spark.createDataFrame(rows, state.TRANSITIONS).coalesce(1).write.mode("append").parquet(str(src))
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
        try:
            run(state.bounded_transitions(spark.readStream.schema(state.TRANSITIONS).parquet(str(src)), horizon=3).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")))
        finally:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [(r.id, r.outcome) for r in spark.read.parquet(out).orderBy("id", "outcome").collect()]
    assert got == [(0, "applied"), (0, state.ASIDE), *((i, "applied") for i in range(1, 6)), (5, "replayed"), (90, state.ASIDE), (91, "kept late")]


def test_updates_and_their_offset_move_together(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "r")
    rows = lambda *x: spark.createDataFrame([(i, f"t{i}") for i in x], "uid long, text string")
    ids = lambda: sorted(r.uid for r in commits.read(spark, root, "acks").collect())
    assert state.acknowledge(rows(3, 4), root, 0) and not state.acknowledge(rows(9), root, 0)

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(commits, "_publish", dies)
        with pytest.raises(RuntimeError):
            state.acknowledge(rows(4, 5), root, 1)
    assert ids() == [3, 4]
    assert state.acknowledge(rows(4, 5, 6), root, 1) and state.acknowledge(rows(2, 6), root, 2) and state.acknowledge(rows(), root, 3) and state.acknowledge(rows(6, 7), root, 4)
    assert ids() == [3, 4, 5, 6, 7]
