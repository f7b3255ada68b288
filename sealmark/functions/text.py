"""Text measures as columns: tokens, overlap, clauses, weight, coverage, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([a-z_][a-z0-9_]*|[一-鿿])"
CLAUSE = r"[.;!?\n]+|, and |, then "
NOISE = r"[\s\p{Punct}]+"


def tokens(text: Column) -> Column:
    """Distinct lower-case identifiers and single CJK characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two token sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(of: Column, in_: Column) -> Column:
    """Share of the tokens of ``of`` that are in ``in_``; 0 if ``of`` is empty."""
    return F.when(F.size(of) == 0, 0.0).otherwise(F.size(F.array_intersect(of, in_)) / F.size(of))


def stripped(text: Column) -> Column:
    """Text without the white space around it."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def clauses(text: Column) -> Column:
    """Clauses, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, CLAUSE), lambda x: F.trim(x)), lambda x: x != "")


def weight(text: Column) -> Column:
    """Code points without punctuation and space."""
    return F.length(F.regexp_replace(text, NOISE, ""))


def own_request(text: Column) -> Column:
    """Text before a ``[continues …]`` line; all of it if that leaves nothing."""
    head = F.regexp_replace(F.element_at(F.split(text, r"(?m)^\[continues [^\]]*\]"), 1), r"^\s+|\s+$", "")
    return F.when(head == "", text).otherwise(head)


def crosses_clause(quote: Column, text: Column) -> Column:
    """Whether no single clause of the text, with what closes it, holds the quote."""
    pieces = F.split(F.regexp_replace(text, f"({CLAUSE})", "$1\x01"), "\x01")
    return ~F.exists(pieces, lambda c: F.contains(c, quote))


def declared(value: Column) -> Column:
    """A declared value; absent, blank and TODO are all null."""
    v = F.trim(value)
    return F.when((v != "") & (v != "TODO"), v)


def word_list(identifier: Column) -> Column:
    """Lower-case words of a camelCase or snake_case identifier."""
    spaced = F.regexp_replace(F.regexp_replace(identifier, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " "), lambda w: w != "")


#: Shapes of credentials, each with what it is replaced by.
CREDENTIALS: list[tuple[str, str]] = [
    (r"(?i)(password|passwd|secret|token|api_?key)(\s*[:=]\s*)[\"']?[A-Za-z0-9+/_.=-]{6,}[\"']?", "$1$2[REDACTED]"),
    (r"AKIA[A-Z0-9]{16,}", "[REDACTED]"),
    (r"\b[0-9a-f]{32,}\b", "[REDACTED]"),
]


def redact(text: Column) -> Column:
    """Credential shapes blanked, one shape after the other."""
    for shape, by in CREDENTIALS:
        text = F.regexp_replace(text, shape, by)
    return text


def show_token(text: Column, ends: int = 3) -> Column:
    """The ends of a token with dots between them."""
    return F.when(F.length(text) <= 2 * ends, F.lit("…")).otherwise(F.concat(F.left(text, F.lit(ends)), F.lit("…"), F.right(text, F.lit(ends))))


def covered(text: Column, quotes: Column) -> Column:
    """Characters of ``text`` that are inside an occurrence of any quote. Occurrences may overlap; each character counts once.

    The starts of each quote are found by scanning on by one character, so self-overlapping occurrences are found.
    """
    spans = F.flatten(F.transform(quotes, lambda q: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: (F.length(q) > 0) & (F.substring(text, i, F.length(q)) == q)), lambda i: F.struct(i.alias("s"), (i + F.length(q)).alias("e")))))
    folded = F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["upto"]))).alias("n"), F.greatest(a["upto"], x["e"]).alias("upto")))
    return folded["n"]


#: Fields that a claim line may have.
CLAIM_FIELDS = ("kind", "file", "symbol", "line", "variant", "note")


def claim_fields(line: Column) -> Column:
    """Map of the ``name=value`` and ``name="value"`` fields of a line; of a name that comes twice the last counts."""
    each = F.regexp_extract_all(line, F.lit(r'(\w+=(?:"[^"]*"|[^\s"]+))'), 1)
    pair = lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_replace(F.regexp_replace(x, r"^\w+=", ""), '^"|"$', "").alias("value"))
    pairs = F.reverse(F.transform(each, pair))
    keys = F.transform(pairs, lambda p: p["key"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1))


def claim_fault(fields: Column, allowed: tuple[str, ...] = CLAIM_FIELDS) -> Column:
    """Why a claim line is refused: fields that are not allowed, or no kind."""
    unknown = F.size(F.array_except(F.map_keys(fields), F.array(*map(F.lit, allowed)))) > 0
    return F.when(unknown, "unknown field").when(~F.map_contains_key(fields, "kind"), "no kind")


def patch_paths(patch: Column) -> Column:
    """Paths that a patch text adds, updates, deletes or moves to, each once, in order; null where it is not wholly a patch.

    A move follows the header of an update; added lines begin with ``+``, those of an update with ``@@``, space, ``+`` or ``-``.
    """
    lines = F.split(F.regexp_replace(patch, r"\r?\n\z", ""), r"\r?\n")
    starts = lambda x, *heads: x.rlike("^(?:" + "|".join(heads) + ")")
    none = F.struct(F.lit("").alias("op"), F.lit(False).alias("body"), F.lit(True).alias("ok"))

    def read(a: Column, x: Column) -> Column:
        op = F.regexp_extract(x, r"^\*\*\* (Add|Update|Delete) File: .", 1)
        moves = starts(x, r"\*\*\* Move to: .")
        body = ((a["op"] == "Add") & starts(x, r"\+")) | ((a["op"] == "Update") & (starts(x, "@@", r"[ +-]") | (x == "*** End of File")))
        head = F.struct(op.alias("op"), (op == "Delete").alias("body"), a["ok"].alias("ok"))
        fine = F.when(moves, (a["op"] == "Update") & ~a["body"]).otherwise(body)
        return F.when(op != "", head).otherwise(F.struct(a["op"].alias("op"), (a["body"] | ~moves).alias("body"), (a["ok"] & fine).alias("ok")))

    inner = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0)))
    named = F.filter(F.transform(inner, lambda x: F.regexp_extract(x, r"^\*\*\* (?:(?:Add|Update|Delete) File|Move to): (.+)$", 1)), lambda x: x != "")
    framed = (F.size(lines) >= 3) & (F.element_at(lines, 1) == "*** Begin Patch") & (F.element_at(lines, -1) == "*** End Patch")
    return F.when(framed & F.aggregate(inner, none, read)["ok"] & (F.size(named) > 0), F.array_distinct(named))


def entry_fault(request: Column, quote: Column, not_done: Column, why: Column, names: Column, acceptance: Column, least_why: int, least_acceptance: int) -> Column:
    """First reason why an entry accounts for no part of a request; null if it does.

    It quotes one clause of the own request; if it declines, it says why; if it delivers, it names what does and what done means.
    """
    own, said = own_request(request), F.trim(F.coalesce(quote, F.lit("")))
    long_ = lambda c, n: F.length(F.trim(F.coalesce(c, F.lit("")))) >= n
    return (
        F.when(said == "", "no quote")
        .when(~F.contains(own, said) & F.contains(request, said), "carried in")
        .when(~F.contains(own, said), "not quoted")
        .when(crosses_clause(said, own), "crosses clauses")
        .when(not_done & ~long_(why, least_why), "silent")
        .when(~not_done & (F.size(names) == 0), "names nothing")
        .when(~not_done & ~long_(acceptance, least_acceptance), "no acceptance")
    )
