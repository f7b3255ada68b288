import pytest
from pyspark.sql import functions as F

from sealmark.functions import predicates as P


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("match", "pattern", "line", "want"), [
    ("symbol", "client.post", "x", True), ("symbol", "get", "sendMail(a)", False), ("regex", "get", "sendMail(a)", True), ("symbol", "getPosts", "readOnly", False), ("symbol", "pay", "", False),
    ("symbol", r"\bINSERT\s+INTO\b", "", True), ("regex", r"\bINSERT\b", "x = 1", False), ("symbol", ".uploadFile", "", True), ("symbol", "s.b.w.d", "", False),
])
def test_replay_words_are_whole_words(spark, match, pattern, line, want):
    assert one(spark, P.replay_sensitive(F.lit(match), F.lit(pattern), F.lit(line))) is want


@pytest.mark.parametrize(("name", "want"), [("idempotencyKey", True), ("Idempotency-Key", True), ("dedupe_x", True), ("client-request-id", True), ("nonce", False), ("oncePerDay", False), ("request_id", False), ("idempotency_nonce", True)])
def test_names_of_keys(spark, name, want):
    assert one(spark, P.idempotency_name(F.lit(name))) is want


@pytest.mark.parametrize(("code", "out", "err", "want"), [(1, " ", "Traceback (most recent call last)", True), (1, "finding", "Traceback (most recent call last)", False), (4, "", "SyntaxError", False), (1, None, None, False)])
def test_crash_is_told_from_a_finding(spark, code, out, err, want):
    assert one(spark, P.crashed(F.lit(code), F.lit(out).cast("string"), F.lit(err).cast("string"))) is want


def test_proofs(spark):
    paths = lambda *p: F.array(*map(F.lit, p)).cast("array<string>")
    proofs = {"ui": ["web/**"], "api": ["srv/**"]}
    assert one(spark, P.proof_status(paths("web/a", "srv/b"), proofs, True)) == "ui,api"
    assert one(spark, P.proof_status(paths("doc"), proofs, True)) == "uncovered"
    assert one(spark, P.proof_status(paths("doc"), proofs, False)) == "not_applicable"
    assert one(spark, P.proof_status(paths(), proofs, True)) == "not_applicable"
    assert one(spark, P.proof_status(F.lit(None).cast("array<string>"), proofs, True)) == "unknown"
    assert one(spark, P.proof_status(paths("doc"), {**proofs, "all": []}, True)) == "all"


def test_authorisation_comes_first(spark):
    assert one(spark, P.vocabulary_reason(F.lit("a"), ["a"], ["a"])) == "decides authorisation"
    assert one(spark, P.traceable(F.lit("x/y.ts"), [".ts"])) is True


@pytest.mark.parametrize(("at", "want"), [
    ("2024-01-10 00:00:00", False), ("2024-01-09 23:59:59.5", True), ("2024-01-09 23:59:59.999999", True), ("2024-01-10 00:00:00.000001", False), ("2024-01-20 00:00:00.999999", False), ("2024-01-20 00:00:01", True), (None, True),
])
def test_summaries_expire_by_whole_seconds(spark, at, want):
    time = lambda t: F.lit(t).cast("timestamp_ntz")
    assert one(spark, P.expired(time(at), time("2024-01-20 00:00:00"), 864_000)) is want
