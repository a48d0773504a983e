"""Metadata of combined recordings: nested documents merged by source and id, the first of a field wins.

Inputs are rows in the order ``pos``: source (a name, or a JSON array of names where the file is itself a combined one), node,
instance, version, interval_ms, systeminfo, descriptions, per_source, selection and events (the last five JSON text).
Documents are taken apart to rows (source, id, field, value), merged by grouping, and put together again; JSON keeps its types
as VARIANT. What is no valid JSON is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrifold.operators.joins import normalize_annotations
from metrifold.sources.readers import parse_annotations

_NESTED = "map<string,map<string,map<string,variant>>>"
_LATE = 1 << 40  # after all inputs' own fields


def _names(source: Column) -> Column:
    """The names that a source stands for."""
    many = F.from_json(source, "array<string>")
    return F.when(source.startswith("[") & many.isNotNull(), many).otherwise(F.array(source))


def _quoted(c: Column) -> Column:
    """A string as a JSON literal."""
    both = F.to_json(F.array(c))
    return F.substring(both, F.lit(2), F.length(both) - 2)


def _object(entries: Column) -> Column:
    """JSON text of an array of (key, value text), by key."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def merge_fields(inputs: DataFrame, agent: str = "agent") -> DataFrame:
    """(source, id, field, value): each source's entries, those of the ``agent`` by node and others by instance, and its descriptions.

    An entry of an already combined input comes whole, unless an earlier one has that entry; an input's own version and
    names join it where they are missing, and an agent's systeminfo last.
    """
    d = inputs.withColumn("name", F.explode(_names(F.col("source"))))
    is_agent = F.col("name") == agent
    id_ = F.when(is_agent, F.coalesce("node", F.lit("unknown"))).otherwise(F.coalesce("instance", F.lit("0")))
    literal = lambda c: F.when(F.col(c).isNotNull(), _quoted(F.col(c)))
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in (("version", literal("version")), ("node", literal("node")), ("instance", F.when(~is_agent, literal("instance"))), ("", F.lit("")))])
    own = d.select(F.col("pos").alias("p"), F.lit(1).alias("q"), F.col("name").alias("source"), id_.alias("id"), F.inline(pairs)).where("value is not null")
    texts = d.select("pos", "name", F.explode(F.from_json("descriptions", "map<string,variant>")).alias("field", "v"))
    own = own.unionByName(texts.select(F.col("pos").alias("p"), F.lit(1).alias("q"), F.col("name").alias("source"), F.lit("descriptions").alias("id"), "field", F.to_json("v").alias("value")))
    nested = inputs.select("pos", F.explode(F.from_json("per_source", _NESTED)).alias("source", "ids")).select("pos", "source", F.explode("ids").alias("id", "fields"))
    before = nested.select(F.col("pos").alias("p"), F.lit(0).alias("q"), "source", "id", F.explode(F.map_concat("fields", F.create_map(F.lit(""), F.parse_json(F.lit("0"))))).alias("field", "v"))
    info = inputs.where(F.col("source") == agent).select((F.col("pos") + _LATE).alias("p"), F.lit(2).alias("q"), F.lit(agent).alias("source"), F.coalesce("node", F.lit("unknown")).alias("id"), F.lit("systeminfo").alias("field"), F.to_json(F.try_parse_json("systeminfo")).alias("value"))
    rows = before.select("p", "q", "source", "id", "field", F.to_json("v").alias("value")).unionByName(own).unionByName(info.where("value is not null"))
    # an entry that another made before takes none of a combined input's fields, and no descriptions but the first ones
    first = rows.groupBy("source", "id").agg(F.min(F.struct("p", "q")).alias("first"))
    rows = rows.join(first, ["source", "id"])
    led = F.struct("p", "q") == F.col("first")
    rows = rows.where(led | ((F.col("q") > 0) & (F.col("id") != "descriptions")))
    return rows.groupBy("source", "id", "field").agg(F.min_by("value", F.struct("p", "q")).alias("value"))


def merge_documents(inputs: DataFrame, agent: str = "agent") -> DataFrame:
    """One row: sources (JSON array, sorted), interval_ms, systeminfo, per_source, selection (of the agent's input, else the first) and annotations."""
    entry = lambda k, v: F.struct(F.col(k).alias("key"), F.col(v).alias("value"))
    fields = merge_fields(inputs, agent)
    ids = fields.groupBy("source", "id").agg(_object(F.filter(F.collect_list(entry("field", "value")), lambda e: e["key"] != "")).alias("text"))
    groups = ids.groupBy("source").agg(_object(F.collect_list(entry("id", "text"))).alias("text"))
    per_source = groups.agg(_object(F.collect_list(entry("source", "text"))).alias("per_source"))  # a document by nature
    mine = F.col("source") == agent
    top = inputs.agg(
        F.to_json(F.array_sort(F.array_distinct(F.flatten(F.collect_list(_names(F.col("source"))))))).alias("sources"),
        F.min_by("interval_ms", F.when(F.col("interval_ms").isNotNull(), F.col("pos"))).alias("interval_ms"),
        F.min_by("systeminfo", F.when(mine & F.col("systeminfo").isNotNull(), F.col("pos"))).alias("systeminfo"),
        F.min_by("selection", F.struct((~mine).alias("a"), "pos")).alias("selection"),
    )
    return top.join(per_source)  # one row each


def merge_annotations(inputs: DataFrame) -> DataFrame:
    """The inputs' events one after another, normalised: by time, of equal ids the first."""
    events = inputs.select("pos", F.get_json_object("events", "$.events").alias("value")).where("value is not null")
    return normalize_annotations(parse_annotations(events.select("value")))
