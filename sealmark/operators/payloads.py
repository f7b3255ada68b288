"""Readers of what events carry: JSON parsed once to a variant, with a stated policy for what cannot be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a reader does with a payload that is no JSON object: leave its row out, take it as an empty object and say so, or stop.
SKIP, CHARGE, FAIL = "skip", "charge", "fail"


def opened(events: DataFrame, policy: str, null_is_empty: bool = False, payload: str = "payload") -> DataFrame:
    """``events`` with ``doc``, the payload as a variant object, and ``unreadable``.

    ``null_is_empty``: a null or empty payload is the empty object, which can be read. Otherwise it cannot. An object that has a field twice cannot be
    read either, unless the session allows it (``spark.sql.variant.allowDuplicateKeys``), nor can lists and plain values.
    """
    text = F.when(F.coalesce(F.col(payload), F.lit("")) == "", "{}").otherwise(F.col(payload)) if null_is_empty else F.col(payload)
    doc = F.try_parse_json(text)
    good = F.coalesce(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), F.lit(False))
    out = events.withColumn("doc", F.when(good, doc)).withColumn("unreadable", F.col("doc").isNull())
    if policy == SKIP:
        return out.filter("NOT unreadable")
    empty = F.parse_json(F.lit("{}"))
    if policy == CHARGE:
        return out.withColumn("doc", F.coalesce("doc", empty))
    if policy == FAIL:
        return out.withColumn("doc", F.when(F.col("unreadable"), F.raise_error(F.concat(F.lit("unreadable payload: "), F.left(F.coalesce(F.col(payload), F.lit("null")), F.lit(60))))).otherwise(F.col("doc")))
    raise ValueError(f"unknown policy {policy}")


def field(name: str, kind: str = "string", default: Column | None = None) -> Column:
    """A field of ``doc``; null, or the default, where it is missing or of another kind."""
    got = F.try_variant_get("doc", f"$.{name}", kind)
    return got if default is None else F.coalesce(got, default)


def withdrawals(events: DataFrame) -> DataFrame:
    """(id, task_id, quote, why) of entries that were cancelled; unreadable ones are left out. ``id`` orders them."""
    return opened(events, SKIP).select("id", "task_id", field("quote").alias("quote"), field("why").alias("why"))


def groupings(events: DataFrame) -> DataFrame:
    """(id, name, claims, why) of every grouping; a missing payload is one without name and claims, unreadable ones are left out."""
    none = F.array().cast("array<string>")
    return opened(events, SKIP, null_is_empty=True).select("id", field("name", default=F.lit("")).alias("name"), field("claims", "array<string>", none).alias("claims"), field("why", default=F.lit("")).alias("why"))


def group_of(groups: DataFrame) -> DataFrame:
    """(claim, name): the latest grouping that each claim is in."""
    return groups.select("id", "name", F.explode("claims").alias("claim")).groupBy("claim").agg(F.max_by("name", "id").alias("name"))


def forbidden(events: DataFrame) -> DataFrame:
    """(task_id, glob, since): what events forbid a task, each once with the first event that did. An unreadable payload stops the reader: it might forbid more."""
    globs = opened(events, FAIL).select("task_id", "id", F.explode(field("globs", "array<string>", F.array().cast("array<string>"))).alias("glob"))
    return globs.groupBy("task_id", "glob").agg(F.min("id").alias("since"))


def current_round(events: DataFrame, by: str, opens: str, closes: str) -> DataFrame:
    """(by, label, frozen) of the open round of each ``by``, from the newest event that opens or closes one; a closed one gives no row."""
    newest = events.filter(F.col("kind").isin(opens, closes)).groupBy(by).agg(F.max_by(F.struct("kind", "payload"), "id").alias("e"))
    return opened(newest.select(by, "e.*").filter(F.col("kind") == opens), FAIL).select(by, field("label").alias("label"), field("acceptance_sha").alias("frozen"))


def rulers(rounds: DataFrame, now: DataFrame, by: str) -> DataFrame:
    """(by, label, verdict) of ``now`` (by, sha): ``no round``, ``unmoved``, or ``moved`` where the criteria are not what the open round froze, or are gone."""
    met = now.join(rounds, by, "left").withColumn("_open", F.col("frozen").isNotNull() | F.col("label").isNotNull())
    return met.select(by, "label", F.when(~F.col("_open"), "no round").when(F.col("sha").eqNullSafe(F.col("frozen")), "unmoved").otherwise("moved").alias("verdict"))


def obligations(families: DataFrame, mapping: DataFrame, registered: DataFrame) -> DataFrame:
    """(family, ids, reusable, answered, missing) of ``families`` (family, ids): which kinds that ``mapping`` (family, kind) asks for are ``registered`` (kind).

    A family with a mapping recurs; the others are of one phase, and nothing answers them.
    """
    marked = mapping.select("family", "kind").distinct().join(registered.select("kind").distinct().withColumn("_known", F.lit(True)), "kind", "left")
    lists = marked.groupBy("family").agg(*(F.array_sort(F.collect_set(F.when(c, F.col("kind")))).alias(n) for n, c in (("answered", F.col("_known")), ("missing", F.col("_known").isNull()))))
    none = F.array().cast("array<string>")
    met = families.join(lists, "family", "left")
    return met.select("family", "ids", F.col("answered").isNotNull().alias("reusable"), F.coalesce("answered", none).alias("answered"), F.coalesce("missing", none).alias("missing"))


# --- baselines -------------------------------------------------------------------------------------

KNOWN, ABSENT, UNREADABLE = "known", "absent", "unreadable"


def baselines(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(states, accepted) of ``files`` (kind, content), where a null content is a file that is not there.

    ``states`` (kind, state, reason): an absent baseline forgives nothing and is no fault; a broken one is, and must not be taken for an
    empty one. ``accepted`` (kind, id): a list, or the list ``accepted``, or else ``findings``, of an object; entries are ids or objects with one.
    """
    doc = F.try_parse_json("content")
    shape = F.schema_of_variant(doc)
    is_list, is_object = F.startswith(shape, F.lit("ARRAY")), F.startswith(shape, F.lit("OBJECT"))
    has = lambda name: F.array_contains(F.json_object_keys("content"), name)
    inner = F.when(is_list, doc).when(is_object & has("accepted"), F.try_variant_get(doc, "$.accepted", "variant")).when(is_object & has("findings"), F.try_variant_get(doc, "$.findings", "variant"))
    rows = files.select("kind", "content", doc.isNull().alias("_broken"), F.try_variant_get(inner, "$", "array<variant>").alias("_entries"))
    text = lambda e: F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string"))
    named = lambda e: F.try_variant_get(e, "$.id", "variant")
    ids = F.transform("_entries", lambda e: F.coalesce(text(e), F.when(F.startswith(F.schema_of_variant(e), F.lit("OBJECT")), text(named(e)))))
    rows = rows.withColumn("_ids", ids)
    odd = F.exists("_ids", lambda x: x.isNull())
    reason = F.when(F.col("_broken"), "no JSON").when(F.col("_entries").isNull(), "no list").when(odd, "an entry without id")
    state = F.when(F.col("content").isNull(), ABSENT).when(reason.isNotNull(), UNREADABLE).otherwise(KNOWN)
    states = rows.select("kind", state.alias("state"), F.when(F.col("content").isNotNull(), reason).alias("reason"))
    accepted = rows.filter(F.col("content").isNotNull() & reason.isNull()).select("kind", F.explode("_ids").alias("id")).distinct()
    return states, accepted


def forgiven(found: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, id, side) of findings (kind, id) against their kind's baseline: ``new``, ``carried`` or ``stale``, or ``unknown`` where the baseline is unreadable."""
    states, accepted = baselines(files)
    f, b = found.select("kind", "id").distinct().withColumn("_f", F.lit(True)), accepted.withColumn("_b", F.lit(True))
    met = f.join(b, ["kind", "id"], "full_outer").join(states.filter(F.col("state") == UNREADABLE).select("kind", F.lit(True).alias("_u")), "kind", "left")
    return met.select("kind", "id", F.when(F.col("_u"), "unknown").when(F.col("_b").isNull(), "new").when(F.col("_f").isNull(), "stale").otherwise("carried").alias("side"))


def stored_baselines(spark, folder: str, kinds: list[str]) -> DataFrame:
    """(kind, content) of ``<folder>/<kind>.json`` for the kinds asked for; null where there is no file."""
    from sealmark.sources.ledger import exists

    asked = spark.createDataFrame([(k,) for k in kinds], "kind string")
    if not exists(spark, folder):
        return asked.select("kind", F.lit(None).cast("string").alias("content"))
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    held = there.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("kind"), F.decode("content", "utf-8").alias("content"))
    return asked.join(held, "kind", "left")
