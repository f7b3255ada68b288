"""Verdicts from several observations, where what was not observed is unknown and not false, and audits in one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exits of a command that never started what it was to run.
COULD_NOT_RUN = (126, 127)


def red_green(runs: DataFrame) -> DataFrame:
    """``runs`` with ``green``, ``red``, ``executed``, ``verdict`` and ``notes``: whether a test passes now, failed before, and ran what it is about.

    ``runs`` has green_exit, red_exit (null: the older tree could not be had), executed (null: nothing was observed), red_executed, and mutated:
    whether the test's own target was broken on purpose. A command that could not run is no red; nor is a failure of a broken target before it was entered.
    The verdict is the conjunction of the three in three-valued logic: true, false, or null where the rest holds and something is unknown.
    """
    ran = lambda c: ~F.col(c).isin(*COULD_NOT_RUN)
    green = F.coalesce(F.col("green_exit") == 0, F.lit(False))
    entered = ~(F.col("mutated") & F.coalesce(~F.col("red_executed"), F.lit(False)))
    red = F.when(F.col("red_exit").isNotNull(), ran("red_exit") & (F.col("red_exit") != 0) & entered)
    note = lambda holds, said: F.when(holds, said)
    failed = F.col("red_exit").isNotNull() & ran("red_exit") & (F.col("red_exit") != 0)
    notes = F.array_compact(F.array(
        note(F.coalesce(~ran("green_exit"), F.lit(False)), "could not run"), note(~green & F.coalesce(ran("green_exit"), F.lit(True)), "does not pass"),
        note(F.col("executed").isNull(), "execution not observed"), note(~F.col("executed"), "target never executed"),
        note(F.col("red_exit").isNull(), "no older tree"), note(~ran("red_exit"), "could not run before"), note(failed & ~entered, "failed before the target was entered"),
        note((F.col("red_exit") == 0) & F.col("mutated"), "does not notice the mutation"), note((F.col("red_exit") == 0) & ~F.col("mutated"), "passed before"),
    ))
    marked = runs.withColumns({"_g": green, "_r": red, "_n": notes})
    return marked.withColumns({"green": F.col("_g"), "red": F.col("_r"), "verdict": F.col("_g") & F.col("_r") & F.col("executed"), "notes": F.col("_n")}).drop("_g", "_r", "_n")


def audit_summary(audits: dict[str, DataFrame], benign: tuple[str, ...] = ()) -> DataFrame:
    """(audit, problems, fatal, exit) of audits (problem), one row each and the worst of them as ``all``; what is ``benign`` is said and is no failure."""
    out = None
    for name, found in audits.items():
        bad = ~F.col("problem").isin(*benign) if benign else F.lit(True)
        one = found.agg(F.count("problem").alias("problems"), F.count(F.when(bad, F.col("problem"))).alias("fatal")).select(F.lit(name).alias("audit"), "problems", "fatal")
        out = one if out is None else out.union(one)
    rows = out.withColumn("exit", (F.col("fatal") > 0).cast("int"))
    worst = rows.agg(F.lit("all").alias("audit"), F.sum("problems").alias("problems"), F.sum("fatal").alias("fatal"), F.max("exit").alias("exit"))
    return rows.union(worst)


def chain_cover(events: DataFrame) -> DataFrame:
    """(bare, hashed): events from before they were chained, and chained ones."""
    hashed = F.coalesce(F.col("row_hash"), F.lit("")) != ""
    return events.agg(F.count_if(~hashed).alias("bare"), F.count_if(hashed).alias("hashed"))


# --- configuration as rows ------------------------------------------------------------------------


def settings(documents: DataFrame, section: str) -> DataFrame:
    """(source, name, field, value, sha) of a section of JSON configurations (source, content): its entries by name, with their fields as JSON text.

    ``sha`` is the digest of the whole document, so what was looked up is tied to the text that said it. A document that cannot be read stops the reader: it is not
    an empty one. A section that is missing has no entries; an entry that is no object has its value under the empty field.
    """
    doc = F.try_parse_json("content")
    good = F.when(F.coalesce(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), F.lit(False)), doc).otherwise(F.raise_error(F.concat(F.lit("unreadable configuration: "), F.coalesce("source", F.lit("")))).cast("variant"))
    held = documents.select("source", F.sha2("content", 256).alias("sha"), F.try_variant_get(good, f"$.{section}", "map<string,variant>").alias("m"))
    entries = held.select("source", "sha", F.explode("m").alias("name", "v"))
    fields = F.coalesce(F.try_variant_get("v", "$", "map<string,variant>"), F.create_map(F.lit(""), F.col("v")))
    return entries.select("source", "name", F.explode(fields).alias("field", "x"), "sha").select("source", "name", "field", F.to_json("x").alias("value"), "sha")


def setting(rows: DataFrame, settings_: DataFrame, name: str, field: str, default: Column | None = None) -> DataFrame:
    """``rows`` with the ``field`` of the entry that the column ``name`` names, as text; the default where there is none."""
    plain = F.when(F.startswith("value", F.lit('"')), F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"]).otherwise(F.col("value"))
    known = settings_.filter(F.col("field") == field).select(F.col("name").alias("_name"), plain.alias("_value"))
    met = rows.join(known, F.col(name) == F.col("_name"), "left")
    value = F.col("_value") if default is None else F.coalesce("_value", default)
    return met.withColumn(field, value).drop("_name", "_value")
