import random

from pyspark.sql import functions as F

from sealmark.operators import aggregates, chain, diff, folds, graph, joins, latest, state


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_latest_keeps_the_row_of_greatest_id(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, None), (2, 2, "c")], "key long, id long, v string")
    assert rows(latest.latest(df, "key")) == [(1, 3, None), (2, 2, "c")]


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 10)] + [("b", x) for x in (5, 5, 7)] + [("c", 4)], "k string, v long")
    assert rows(aggregates.upper_medians(df, "k", "v")) == [("a", 4, 3, 10), ("b", 3, 5, 7), ("c", 1, 4, 4)]


def test_scope_fold_is_the_ordered_fold(spark):
    rng = random.Random(3)
    moves = [(i, rng.randint(1, 3), rng.choice(["scope_widen", "scope_narrow"]), rng.choice("abcd"), rng.choice([True, False, None])) for i in range(200)]
    base = [(1, "a"), (2, "b")]
    expect = {t: {g for k, g in base if k == t} for t in (1, 2, 3)}
    for _, t, kind, g, ok in moves:
        if kind == "scope_narrow":
            expect[t].discard(g)
        elif ok is not False:
            expect[t].add(g)
    shuffled = rng.sample(moves, len(moves))
    got = folds.current_scope(spark.createDataFrame(base, "task_id long, glob string"), spark.createDataFrame(shuffled, "id long, task_id long, kind string, glob string, accepted boolean"))
    assert {(r.task_id, r.glob) for r in got.collect()} == {(t, g) for t, s in expect.items() for g in s}


def test_withdrawal_cancels_only_earlier_entries(spark):
    e = spark.createDataFrame([(1, "q"), (5, "q"), (2, "r")], "id long, quote string")
    w = spark.createDataFrame([(3, "q")], "id long, quote string")
    assert rows(folds.standing(e, w, ["quote"]).select("id")) == [(2,), (5,)]


def test_merge_keeps_fields_that_later_payloads_lack(spark):
    df = spark.createDataFrame([(1, "r", {"a": "1", "b": "1"}), (2, "r", {"a": "2"})], "id long, key string, payload map<string,string>")
    assert rows(folds.merged(df, "key")) == [("r", "a", "2"), ("r", "b", "1")]


def _chain(spark, n=40):
    df = spark.createDataFrame([(i, f"k{i % 3}", None if i % 5 == 0 else f"p{i}") for i in range(n)], "id long, kind string, payload string")
    return chain.build(df, ["kind", "payload"], "s1")


def test_whole_chain_has_no_problem(spark):
    assert rows(chain.walk(_chain(spark), ["kind", "payload"])) == []


def test_chain_walk_names_each_fault(spark):
    built = [r.asDict() for r in _chain(spark).orderBy("id").collect()]
    built[7]["payload"] = "edited"
    built[20]["prev_hash"] = built[10]["row_hash"]  # two faults: the link, and the row's own hash
    del built[30]
    built[35]["row_hash"] = built[35]["prev_hash"] = ""
    df = spark.createDataFrame([tuple(r.values()) for r in built], _chain(spark).schema)
    got = dict(rows(chain.walk(df, ["kind", "payload"])))
    after = built[36]["id"]
    assert got == {7: "hash", 20: "hash", 31: "broken", built[35]["id"]: "unhashed", after: "broken"}


def test_fork_is_told_from_a_break(spark):
    good = [r.asDict() for r in _chain(spark, 10).orderBy("id").collect()]
    import hashlib

    fork = dict(good[9])
    fork["prev_hash"] = good[4]["row_hash"]
    fork["row_hash"] = hashlib.sha256("\x1f".join(["s1", fork["prev_hash"], fork["kind"], fork["payload"]]).encode()).hexdigest()
    df = spark.createDataFrame([tuple(r.values()) for r in [*good[:9], fork]], _chain(spark).schema)
    assert rows(chain.walk(df, ["kind", "payload"])) == [(9, "fork")]


def test_anchor(spark):
    c = _chain(spark, 10)
    tip = chain.tip(c.filter("id <= 6")).first()
    assert chain.anchored(c, tip.n, tip.last_id, tip.head).first().ok
    assert not chain.anchored(c.filter("id != 3"), tip.n, tip.last_id, tip.head).first().ok


def test_snapshot_diff_and_its_text(spark):
    b = spark.createDataFrame([(f"p{i}", "1") for i in range(10)], "path string, sha string")
    a = spark.createDataFrame([(f"p{i}", "2" if i == 9 else "1") for i in range(8, 18)], "path string, sha string")
    d = diff.snapshot_diff(b, a)
    assert rows(d)[:1] == [("p0", "-")] and ("p9", "~") in rows(d) and ("p10", "+") in rows(d)
    shown = dict(rows(diff.shown(d, 3)))
    assert shown["-"] == "p0, p1, p2, …and 5 more" and shown["~"] == "p9"


def test_moved_keys_tell_missing_from_equal(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2, "c": 3}, {"a": 1, "b": 3, "d": 4})], "x map<string,int>, y map<string,int>")
    assert df.select(diff.moved_keys(F.col("x"), F.col("y"))).first()[0] == ["b", "c", "d"]


def test_stale_findings_need_a_complete_scan(spark):
    f, b = (spark.createDataFrame([(i,) for i in x], "id long") for x in ([1, 2], [2, 3]))
    assert rows(diff.baseline_split(f, b, True)) == [(1, "new"), (2, "carried"), (3, "stale")]
    assert rows(diff.baseline_split(f, b, False)) == [(1, "new"), (2, "carried")]


def test_state_precedence(spark):
    claims = spark.createDataFrame([(i, "k") for i in range(12)], "id long, kind string")
    attempts = spark.createDataFrame([(0, 1, 0, "d"), (1, 1, 1, "d"), (2, 1, 4, "d"), (3, 1, 5, "d"), (4, 1, 77, "d"), (5, 1, 0, "d"), (6, 1, 0, "d"), (8, 1, 4, "d")], "claim_id long, id long, exit_code int, subject_digest string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "claim_id long")
    now = spark.createDataFrame([(5, "moved"), (0, "d"), (6, "d"), (9, "d"), (10, "d"), (11, "d")], "claim_id long, digest string")
    # Of 9 the newest signature is for what is current, of 10 an older one is, of 11 it cannot be read.
    signed = spark.createDataFrame([(6, 1, "d"), (9, 1, "x"), (9, 2, "d"), (10, 1, "d"), (10, 2, "x"), (11, 1, None)], "claim_id long, id long, key string")
    got = {r.id: (r.state, r.reason) for r in state.states(claims, attempts, signed, ids(6, 1), now, ids(8)).collect()}
    assert got == {
        0: ("ANSWERED", None), 1: ("RETRACTED", None), 2: ("UNSUPPORTED", None), 3: ("TIMEOUT", None), 4: ("UNKNOWN_EXIT", None), 5: ("STALE", "subject"),
        6: ("RETRACTED", None), 7: ("OPEN", None), 8: ("RISK_ACCEPTED", None),
        9: ("RISK_ACCEPTED", None), 10: ("OPEN", None), 11: ("OPEN", None),
    }


def test_components_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6)], "src long, dst long")
    assert dict(rows(graph.components(edges))) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert rows(graph.cycle_edges(edges).select("src", "dst")) == [(1, 2), (2, 3), (3, 1)]


def test_longest_prefix(spark):
    n = spark.createDataFrame([("a.b.c",), ("a.x",), ("z",)], "name string")
    i = spark.createDataFrame([("a",), ("a.b",)], "module string")
    assert dict(rows(joins.longest_prefix(n, i))) == {"a.b.c": "a.b", "a.x": "a", "z": None}


def test_open_tasks_survive_a_null_ending(spark):
    t = spark.createDataFrame([(1,), (2,)], "id long")
    ended = spark.createDataFrame([(None,), (2,)], "task_id long")
    assert rows(joins.open_tasks(t, ended)) == [(1,)]
