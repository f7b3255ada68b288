"""Identities and digests. Fields are joined with a separator that text does not hold; a null field is the empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT, RECORD = "\x1f", "\x1e"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def joined(*fields: Column, sep: str = UNIT) -> Column:
    """Fields with a separator between them. ``concat_ws`` alone would skip nulls."""
    return F.concat_ws(sep, *(_text(f) for f in fields))


def short_id(*fields: Column, sep: str = UNIT) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the joined fields."""
    return F.substring(F.sha2(joined(*fields, sep=sep), 256), 1, 16)


def finding_id(*fields: Column) -> Column:
    """Identity of a finding; its line number is no part of it."""
    return short_id(*fields, sep="\x00")


def event_hash(prev: Column, scheme: Column, *fields: Column) -> Column:
    """Hash of an event of a chain, over the hash before it."""
    return F.sha2(joined(scheme, prev, *fields), 256)


def prefixed(*fields: Column) -> Column:
    """Fields each with its length before it, so that no text can move from one field to the next."""
    return F.concat(*(F.concat(F.length(_text(f)).cast("string"), F.lit(":"), _text(f)) for f in fields))


def row_hash(prev: Column, *fields: Column) -> Column:
    """Hash of an attempt of a chain, over length-prefixed fields."""
    return F.sha2(prefixed(prev, *fields), 256)


def attempt_hash(scheme: Column, prev: Column, fields: list[Column], claim_digest: Column, worktree: Column, facts: Column) -> Column:
    """Hash of an attempt under the scheme it was written with, told by the last digit of the scheme's name.

    1 joins the fields; 2 adds the claim's digest; 3 puts lengths before them; 4 adds the worktree and the facts' digest.
    """
    base, n = [scheme, prev, *fields], F.right(scheme, F.lit(1))
    material = F.when(n == "1", joined(*base)).when(n == "2", joined(*base, claim_digest)).when(n == "3", prefixed(*base, claim_digest)).when(n == "4", prefixed(*base, claim_digest, worktree, facts))
    return F.sha2(material, 256)


def ref_key(kind: Column, path: Column, claim: Column) -> Column:
    """``file:path`` or ``attempt:claim``."""
    return F.when(kind == "file", F.concat(F.lit("file:"), path)).otherwise(F.concat(F.lit("attempt:"), claim))
