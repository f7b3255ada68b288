"""Review rounds: what a complete sweep is, what is due, and whether texts say something of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealmark.functions import text as X
from sealmark.operators.similar import repeated


def complete(expected: Column, reviewed: Column, inconclusive: Column) -> Column:
    """Whether every expected lens was reviewed or is inconclusive, and all counts are 0 or more. Maps of counts by lens."""
    named = F.array_union(F.map_keys(reviewed), F.map_keys(inconclusive))
    fine = F.forall(F.map_values(reviewed), lambda n: F.coalesce(n >= 0, F.lit(False)))
    return F.coalesce((F.size(F.array_except(expected, named)) == 0) & fine, F.lit(False))


def reconciled(claimed: Column, observed: Column, note: Column, floor: int) -> Column:
    """A count that is not what was observed needs a note of some length."""
    return (claimed == observed) | (F.length(F.coalesce(note, F.lit(""))) >= floor)


def coverage(classes: DataFrame, kinds: DataFrame) -> DataFrame:
    """(risk_class, mark): ``OK`` with a kind that is checked, ``half`` with judged kinds only, ``--`` with none."""
    met = classes.join(kinds, "risk_class", "left").groupBy("risk_class").agg(F.count("kind").alias("n"), F.count_if(~F.col("judged")).alias("checked"))
    return met.select("risk_class", F.when(F.col("checked") > 0, "OK").when(F.col("n") > 0, "half").otherwise("--").alias("mark"))


def judged(sentence: Column, subject: Column, rules: Column, least: int) -> Column:
    """First reason to refuse a sentence: empty, short, off the subject, a credential in it, or all of a rule recited.

    Its length counts without the space around it; a subject without a word of more than two characters asks for nothing.
    """
    own, said = X.tokens(sentence), X.stripped(F.coalesce(sentence, F.lit("")))
    words = F.filter(F.split(F.lower(subject), r"[\s/.]+"), lambda w: F.length(w) > 2)
    recited = F.coalesce(F.array_max(F.transform(rules, lambda r: X.containment(X.tokens(r), own))), F.lit(0.0))
    return (
        F.when(said == "", "empty")
        .when(F.length(said) < least, "short")
        .when((F.size(words) > 0) & ~F.arrays_overlap(own, words), "off subject")
        .when(X.redact(sentence) != sentence, "credential")
        .when(recited >= 1.0, "recited")
    )


def judged_over_history(rows: DataFrame, history: DataFrame, rules: Column, least: int, threshold: float) -> DataFrame:
    """``rows`` (sentence, template, subject, about, ...) with ``refusal``, the first of seven reasons: the question restated, the five of ``judged``,
    or a repeat of an accepted sentence of ``history`` (sentence, about) about something else."""
    again = repeated(rows, history, threshold).select(F.col("sentence").alias("_said"), F.col("about").alias("_about"), F.lit(True).alias("_again"))
    met = rows.join(again, (F.col("sentence") == F.col("_said")) & (F.coalesce(F.col("about").cast("string"), F.lit("")) == F.col("_about")), "left")
    restated_ = X.stripped(F.coalesce("sentence", F.lit(""))) == X.stripped(F.coalesce("template", F.lit("")))
    first = F.coalesce(F.when(restated_, "restated"), judged(F.col("sentence"), F.col("subject"), rules, least), F.when(F.col("_again"), "repeated"))
    return met.select(*rows.columns, first.alias("refusal"))


def restated(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """(pattern, verdict, line): cited lines that still match, that moved to the only new place, or are gone or ambiguous."""
    found = hits.groupBy("pattern").agg(F.count("*").alias("n"), F.min("line").alias("only"), F.collect_set("line").alias("lines"))
    met = citations.join(found, "pattern", "left")
    verdict = F.when(F.col("n").isNull(), "gone").when(F.array_contains("lines", F.col("line")), "holds").when(F.col("n") == 1, "moved").otherwise("ambiguous")
    return met.select("pattern", verdict.alias("verdict"), F.when(F.col("n").isNotNull() & F.array_contains("lines", F.col("line")), F.col("line")).when(F.col("n") == 1, F.col("only")).alias("line"))
