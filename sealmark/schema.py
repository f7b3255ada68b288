"""Schemas of the six ledger tables and the closed vocabularies they are checked against."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _table(required: dict[str, T.DataType], optional: dict[str, T.DataType] | None = None) -> T.StructType:
    fields = [T.StructField(n, t, False) for n, t in required.items()]
    return T.StructType(fields + [T.StructField(n, t, True) for n, t in (optional or {}).items()])


REF = T.StructType([T.StructField("kind", _S), T.StructField("path", _S), T.StructField("claim", _S)])
TABLES: dict[str, T.StructType] = {
    "task": _table({"id": _S, "request": _S, "scope_globs": T.ArrayType(_S), "base_commit": _S, "created_at": _TS}),
    "claim": _table({"id": _S, "task_id": _S, "kind": _S, "question": _S, "subject_refs": T.ArrayType(REF), "checker": _S, "origin": _S, "created_at": _TS}, {"file": _S, "symbol": _S, "variant": _S, "line": _I, "note": _S, "detector": _S, "detector_sha": _S}),
    "attempt": _table({"id": _L, "claim_id": _S, "subject_digest": T.MapType(_S, _S), "checker_sha": _S, "config_sha": _S, "head_commit": _S, "worktree": _S, "argv": T.ArrayType(_S), "exit_code": _I, "stdout": _S, "stderr": _S, "started_at": _TS, "ended_at": _TS, "duration_ms": _L, "claim_digest": _S, "facts_sha": _S, "scheme": _S, "prev_hash": _S, "row_hash": _S}),
    "event": _table({"id": _L, "kind": _S, "actor": _S, "payload": _S, "created_at": _TS, "prev_hash": _S, "row_hash": _S, "scheme": _S}, {"task_id": _S, "claim_id": _S}),
    "accepted_risk": _table({"id": _L, "claim_id": _S, "kind": _S, "who": _S, "why": _S, "was_tty": _I, "signed_by": _S, "git_record": _S, "subject_digest": _S, "created_at": _TS, "scope": _S, "cover_key": _S}),
    "cost_observation": _table({"id": _L, "source": _S, "created_at": _TS}, {"task_id": _S, "claim_id": _S, "tokens": _L, "wall_ms": _L}),
}
#: Columns that older stores lack, with what stands for them there.
ADDED: dict[str, dict[str, object]] = {
    "attempt": {"claim_digest": "", "facts_sha": "", "scheme": "chain-1", "worktree": ""},
    "event": {"prev_hash": "", "row_hash": "", "scheme": ""},
    "accepted_risk": {"scope": "task", "cover_key": "", "signed_by": ""},
}
# Columns of each table that hold free text, redacted when rows are written and again when they are exported.
FREE_TEXT: dict[str, tuple[str, ...]] = {"event": ("payload",), "accepted_risk": ("why",), "claim": ("note", "question"), "task": ("request",)}
# Exit codes of a check and the states they lead to.
EXITS: dict[int, str] = {0: "PASS", 1: "FAIL", 4: "UNSUPPORTED", 5: "TIMEOUT", 6: "CRASH", 7: "SUBJECT_MOVED", 8: "CHECKER_MOVED"}
# States that need no more work.
TERMINAL: tuple[str, ...] = ("ANSWERED", "RISK_ACCEPTED", "RETRACTED")
