"""What runs tell of the environment: applications, how they are opened, settings below them, keyboard shortcuts.

Facts of each run are counted by key and merged into stored state, tables with nested maps, by a full outer join on the key and
a merge of the maps. Counts add up, times take the first or last, so increments in order end as one pass over all.
A run counts once for an application, a setting or a shortcut, and each time for a way to open an application.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.functions.patterns import KNOWN_APPS, SHORTCUTS

ENTITIES = "key string, display string, interactions long, first_seen long, last_seen long, methods map<string,struct<method:string,command:string,observations:long,last_seen:long>>, children map<string,struct<display:string,access:string,observations:long>>"
SHORTCUT_STATE = "key string, action string, observations long, last_seen long"
APP = r"""(?i)open\s+-a\s+["']?([^"'\s;]+(?:\s+[^"'\s;]+)?)["']?"""
SCHEME = r"""(?i)open\s+["']?(x-apple[^"'\s]+)["']?"""


def confidence(observations: Column) -> Column:
    return F.least(F.lit(0.95), observations / (observations + 3.0))


def _said(action: Column, kind: str) -> Column:
    """A typed text or key, out of its raw form if it isn't there by itself."""
    text = F.coalesce(F.nullif(action.text, F.lit("")), action.raw, F.lit(""))
    return F.regexp_replace(F.regexp_replace(text, rf"""^(?i){kind}:\s*["']?""", ""), r"""["']$""", "")


def _steps(runs: DataFrame) -> DataFrame:
    """(run, at, k, action, before): each action with the one before it."""
    n = runs.select("run", "at", "nodes", F.posexplode("nodes").alias("k", "n"))
    return n.select("run", "at", "k", F.col("n.action").alias("action"), F.get("nodes", F.col("k") - 1).action.alias("before")).where("action is not null")


def entity_facts(runs: DataFrame) -> DataFrame:
    """(run, at, place, key, display, method, command, child, access) from runs (run, at, description, nodes, states).

    ``nodes`` have an action (type, text, raw), ``states`` are the scenes of its checkpoints. Applications come from 'open -a', from
    what is typed after the launcher's shortcut, and, if they are known ones, from scenes and the description.
    """
    s, a = _steps(runs), F.col("action")
    raw = F.coalesce(a.raw, F.lit(""))
    none = F.lit(None).cast("string")
    dashed = lambda name: F.regexp_replace(F.lower(name), r"\s+", "-")
    columns = ["run", "at", "place", "key", "display", "method", "command", "child", "access"]

    name = F.trim(F.regexp_extract(raw, APP, 1))
    opened = s.where(a.type == "bash").withColumn("name", name).where("name != ''").select(
        "run", "at", F.struct(F.lit(0).alias("part"), "k", F.lit(0).alias("i")).alias("place"), dashed(F.col("name")).alias("key"), F.col("name").alias("display"), F.lit("bash").alias("method"), F.concat(F.lit('open -a "'), "name", F.lit('"')).alias("command"), none.alias("child"), none.alias("access"))
    scheme = F.regexp_extract(raw, SCHEME, 1)
    pane = F.regexp_replace(F.regexp_replace(F.regexp_extract(scheme, r"com\.apple\.([A-Za-z]+)", 1), "Settings$", ""), "Preferences$", "")
    panes = s.where(a.type == "bash").withColumn("scheme", scheme).withColumn("pane", pane).where("pane != ''").select(
        "run", "at", F.struct(F.lit(0).alias("part"), "k", F.lit(1).alias("i")).alias("place"), F.lit("system-settings").alias("key"), F.lit("System Settings").alias("display"), none.alias("method"), none.alias("command"), F.col("pane").alias("child"), F.concat(F.lit("open '"), "scheme", F.lit("'")).alias("access"))
    before = F.lower(F.coalesce(F.nullif(F.col("before.text"), F.lit("")), F.col("before.raw"), F.lit("")))
    typed = F.trim(F.split_part(F.trim(_said(a, "type")), F.lit("\n"), F.lit(1)))
    launched = s.where(a.type.isin("type", "type_text") & (F.contains(before, F.lit("cmd+space")) | F.contains(before, F.lit("command+space")))).withColumn("name", typed)
    launched = launched.where((F.length("name") > 1) & (F.length("name") < 40) & ~F.col("name").rlike(r"[/\\]")).select(
        "run", "at", F.struct(F.lit(0).alias("part"), "k", F.lit(2).alias("i")).alias("place"), F.regexp_replace(dashed(F.col("name")), "[^a-z0-9-]", "").alias("key"), F.col("name").alias("display"), F.lit("spotlight").alias("method"), none.alias("command"), none.alias("child"), none.alias("access"))
    seen = F.lower(F.concat_ws("\n", "states", "description"))
    known = runs.select("run", "at", F.posexplode(F.filter(F.array(*map(F.lit, KNOWN_APPS)), lambda x: F.contains(seen, x))).alias("k", "name")).select(
        "run", "at", F.struct(F.lit(1).alias("part"), "k", F.lit(0).alias("i")).alias("place"), dashed(F.col("name")).alias("key"), F.initcap("name").alias("display"), none.alias("method"), none.alias("command"), none.alias("child"), none.alias("access"))
    return opened.select(columns).unionByName(panes).unionByName(launched).unionByName(known)


def entities(runs: DataFrame) -> DataFrame:
    """The state (``ENTITIES``) that these runs make by themselves."""
    f = entity_facts(runs)
    by_run = f.groupBy("key", "run").agg(F.max("at").alias("at"), F.min(F.struct("at", "run", "place", "display")).alias("first"))
    own = by_run.groupBy("key").agg(F.min("first").getField("display").alias("display"), F.count("*").alias("interactions"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    ways = f.where("method is not null").groupBy("key", "method", "command").agg(F.count("*").alias("observations"), F.max("at").alias("last_seen"))
    way = F.struct(F.concat_ws(" ", "method", "command").alias("k"), F.struct("method", "command", "observations", "last_seen").alias("v"))
    methods = ways.groupBy("key").agg(F.map_from_entries(F.collect_list(way)).alias("methods"))
    below = f.where("child is not null").groupBy("key", F.lower("child").alias("c"), "run").agg(F.max("at").alias("at"), F.max_by(F.struct("child", "access"), "place").alias("x"))
    below = below.groupBy("key", "c").agg(F.count("*").alias("observations"), F.min_by("x", F.struct("at", "run")).alias("x"))
    child = F.struct(F.col("c").alias("k"), F.struct(F.col("x.child").alias("display"), F.col("x.access").alias("access"), "observations").alias("v"))
    children = below.groupBy("key").agg(F.map_from_entries(F.collect_list(child)).alias("children"))
    return _typed(own.join(methods, "key", "left").join(children, "key", "left"), ENTITIES)


def _typed(df: DataFrame, schema: str) -> DataFrame:
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    empty = lambda f: F.coalesce(F.col(f.name), F.create_map().cast(f.dataType)) if f.dataType.typeName() == "map" else F.col(f.name)
    return df.select(*[empty(f).cast(f.dataType).alias(f.name) for f in fields])


def merged_entities(state: DataFrame, more: DataFrame) -> DataFrame:
    """Stored state and what came after it, by key."""
    a, b = state.alias("a"), more.alias("b")
    both = a.join(b, F.col("a.key") == F.col("b.key"), "full_outer")
    pick = lambda name: F.coalesce(F.col(f"a.{name}"), F.col(f"b.{name}"))
    none = lambda x: F.coalesce(x, F.lit(0))

    def maps(name: str, join) -> Column:
        empty = lambda c: F.coalesce(c, F.create_map().cast(state.schema[name].dataType))
        return F.map_zip_with(empty(F.col(f"a.{name}")), empty(F.col(f"b.{name}")), lambda k, x, y: join(x, y))

    way = lambda x, y: F.struct(F.coalesce(x.method, y.method).alias("method"), F.coalesce(x.command, y.command).alias("command"), (none(x.observations) + none(y.observations)).alias("observations"), F.greatest(x.last_seen, y.last_seen).alias("last_seen"))
    child = lambda x, y: F.struct(F.coalesce(x.display, y.display).alias("display"), F.coalesce(x.access, y.access).alias("access"), (none(x.observations) + none(y.observations)).alias("observations"))
    out = both.select(
        pick("key").alias("key"), pick("display").alias("display"), (none(F.col("a.interactions")) + none(F.col("b.interactions"))).alias("interactions"),
        F.least("a.first_seen", "b.first_seen").alias("first_seen"), F.greatest("a.last_seen", "b.last_seen").alias("last_seen"), maps("methods", way).alias("methods"), maps("children", child).alias("children"),
    )
    return _typed(out, ENTITIES)


def shortcuts(runs: DataFrame) -> DataFrame:
    """The state (``SHORTCUT_STATE``) of the command shortcuts that these runs used."""
    a = F.col("action")
    said = F.lower(_said(a, "key"))
    key = F.regexp_replace(F.regexp_replace(said, r"^((?:(?!command\+).)*)command\+", "$1cmd+"), r"\s+", "")
    used = _steps(runs).where(a.type.isin("key", "key_combo") & (F.contains(said, F.lit("cmd+")) | F.contains(said, F.lit("command+")))).select("run", "at", key.alias("key")).distinct()
    names = F.create_map(*[F.lit(x) for pair in SHORTCUTS.items() for x in pair])
    action = F.coalesce(F.try_element_at(names, F.col("key")), F.concat(F.lit("Keyboard shortcut: "), "key"))
    counted = used.groupBy("key", "run").agg(F.max("at").alias("at")).groupBy("key").agg(F.count("*").alias("observations"), F.max("at").alias("last_seen"))
    return _typed(counted.withColumn("action", action), SHORTCUT_STATE)


def merged_shortcuts(state: DataFrame, more: DataFrame) -> DataFrame:
    both = state.unionByName(more).groupBy("key").agg(F.first("action").alias("action"), F.sum("observations").alias("observations"), F.max("last_seen").alias("last_seen"))
    return _typed(both, SHORTCUT_STATE)


def capped(state: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first rows of a state, in the order given."""
    return state.orderBy(*order).limit(most)


def ways(state: DataFrame) -> DataFrame:
    """(key, display, interactions, method, command, observations, confidence): a row for each way to an application; one without a method where none is known."""
    each = state.select("key", "display", "interactions", F.explode_outer(F.map_values("methods")).alias("m"))
    return each.select("key", "display", "interactions", "m.method", "m.command", "m.observations", F.round(confidence(F.col("m.observations")), 6).alias("confidence"))
