"""Predicates over names, outputs and registries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sealmark.functions.globs import any_match
from sealmark.functions.text import word_list

# Verbs whose repetition is a second side effect; words and whole names of keys that tell a repeated request.
# A nonce must differ each time where such a key must not, so it is none of them.
REPLAY_VERBS = ("add", "adjust", "append", "charge", "cp", "create", "dispatch", "enqueue", "executemany", "generate", "insert", "mutation", "notify", "post", "publish", "refund", "send", "sendmail", "submit", "upload")
IDEMPOTENCY_WORDS = ("clientmutationid", "dedup", "dedupe", "idempotence", "idempotency", "idempotent")
IDEMPOTENCY_NAMES = ("client_mutation_id", "client_request_id", "clientmutationid", "dedup_key", "dedupe_key", "idempotence_key", "idempotency_key", "idempotencykey", "operation_key", "request_key", "transaction_key")
#: Letters that are signs of regular expressions where they stand alone.
REGEX_LETTERS = ("b", "d", "s", "w")


def pattern_words(pattern: Column) -> Column:
    """Words of a symbol or a regular expression, without the expression's own letters."""
    chunks = F.regexp_extract_all(pattern, F.lit(r"([\p{L}_]+)"), 1)
    return F.array_except(word_list(F.array_join(chunks, " ")), F.array(*map(F.lit, REGEX_LETTERS)))


def replay_sensitive(match: Column, pattern: Column, line: Column) -> Column:
    """Whether replaying a write leaves a second side effect: a symbol tells by its own words, a regular expression by those of the line it matched."""
    words = F.when(match == "regex", pattern_words(line)).otherwise(pattern_words(pattern))
    return F.arrays_overlap(words, F.array(*map(F.lit, REPLAY_VERBS)))


def idempotency_name(identifier: Column) -> Column:
    """Whether a name is that of a key that tells a repeated request, as a whole or by one of its words."""
    whole = F.replace(F.lower(identifier), F.lit("-"), F.lit("_")).isin(*IDEMPOTENCY_NAMES)
    return whole | F.arrays_overlap(word_list(identifier), F.array(*map(F.lit, IDEMPOTENCY_WORDS)))


def traceable(path: Column, suffixes: list[str]) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1).isin(suffixes)


def crashed(exit_code: Column, stdout: Column, stderr: Column) -> Column:
    """A failing exit that is a crash of the checker and no finding."""
    return (exit_code == 1) & (F.trim(F.coalesce(stdout, F.lit(""))) == "") & F.coalesce(stderr, F.lit("")).rlike(r"Traceback \(most recent call last\)|SyntaxError")


def proof_status(changed: Column, proofs: dict[str, list[str]], required: bool) -> Column:
    """For an array of changed paths: the proofs that apply, or why none does."""
    applies = lambda globs: F.exists(changed, lambda p: any_match(p, globs)) if globs else F.lit(True)
    hit = [F.when(applies(globs), F.lit(name)) for name, globs in proofs.items()]
    names = F.array_compact(F.array(*hit)) if hit else F.array().cast("array<string>")
    none = F.when(changed.isNull(), "unknown").when(F.size(changed) == 0, "not_applicable").otherwise("uncovered" if required else "not_applicable")
    return F.when(F.size(names) > 0, F.array_join(names, ",")).otherwise(none)


def vocabulary_reason(name: Column, auth: list[str], outbound: list[str]) -> Column:
    """Why a name needs a check; authorisation comes before outbound traffic."""
    return F.when(name.isin(auth), "decides authorisation").when(name.isin(outbound), "writes outside")


def expired(at: Column, now: Column, most_seconds: int) -> Column:
    """Whether a cached summary is too old, or of the future, by the seconds of both clocks: fractions are dropped from each before they are compared."""
    second = lambda t: F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t) / 1_000_000)
    age = second(now) - second(at)
    return F.coalesce((age < 0) | (age > most_seconds), F.lit(True))


def attribution(who: Column, signed_by: Column, was_tty: Column) -> Column:
    """One line on who signed and how."""
    how = F.when(signed_by == "human", F.when(was_tty == 1, "at a terminal").otherwise("not at a terminal")).when(signed_by == "agent", "as an agent").otherwise("by an unrecorded signer")
    return F.format_string("signed %s by %s", how, F.coalesce(who, F.lit("nobody")))
