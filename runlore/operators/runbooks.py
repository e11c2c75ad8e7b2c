"""Runbooks: listing, scoped lookup, parameters, import, export and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlore.functions.text import unescape_variables, variables

GLOBAL = "_global"
NAME = "^[a-z][a-z0-9-]*$"
_DOC = T.StructType().add("description", "string").add("commands", T.ArrayType(T.StructType().add("cmd", "string").add("comment", "string")))


def listing(steps: DataFrame) -> DataFrame:
    """Groups of every scope with size and parameters: scope, group_name, n_steps, variables (sorted), shadows.

    A group of a repository shadows the global one of the same name. A group that occurs twice is one.
    """
    g = steps.select("scope", "group_name", "step_no", "cmd", F.explode_outer(variables(F.col("cmd"))).alias("v"))
    g = g.groupBy("scope", "group_name").agg(F.count_distinct(F.struct("step_no", "cmd")).alias("n_steps"), F.array_sort(F.collect_set("v")).alias("variables"))
    shared = steps.where(F.col("scope") == GLOBAL).select("group_name").distinct().withColumn("is_global", F.lit(True))
    g = g.join(shared, "group_name", "left")
    return g.select("scope", "group_name", "n_steps", F.array_join("variables", ",").alias("variables"), ((F.col("scope") != GLOBAL) & F.coalesce("is_global", F.lit(False))).alias("shadows"))


def lookup(steps: DataFrame, name: str, scope: str | None = None, force_global: bool = False) -> DataFrame:
    """The steps of a group, the repository's before the global one, in order."""
    found = steps.where(F.col("group_name") == name)
    rank = F.when((F.col("scope") == F.lit(scope)) & F.lit(not force_global), 2).when(F.col("scope") == GLOBAL, 1)
    found = found.withColumn("rank", rank).where("rank is not null")
    best = found.agg(F.max("rank").alias("rank"))
    return found.join(F.broadcast(best), "rank").drop("rank").orderBy("step_no", "cmd")


def shadowing(steps: DataFrame, scope: str) -> DataFrame:
    """Names that exist in both scopes."""
    names = lambda s: steps.where(F.col("scope") == s).select("group_name")
    return names(scope).intersect(names(GLOBAL))


def declarations(steps: DataFrame) -> DataFrame:
    """Parameters of each step with their defaults: scope, group_name, step_no, name, default_value.

    Declared ones give the default (the last declaration counts, an empty default is one); names found in the
    command come along without.
    """
    base = ["scope", "group_name", "step_no"]
    seen = steps.select(*base, F.explode(variables(F.col("cmd"))).alias("name")).withColumn("default_value", F.lit(None).cast("string")).withColumn("at", F.lit(-1))
    told = steps.select(*base, F.posexplode("vars").alias("at", "v")).select(*base, F.col("v.name").alias("name"), F.col("v.default_value").alias("default_value"), "at")
    return seen.unionByName(told).groupBy(*base, "name").agg(F.max_by("default_value", "at").alias("default_value"))


def resolve(names: DataFrame, inline: DataFrame, env: DataFrame, store: DataFrame, defaults: DataFrame) -> DataFrame:
    """The value of every name from the first source that has one: name, value, source.

    Sources are tables (name, value) with one row a name; an empty value counts, a missing one does not; what no
    source has must be asked for.
    """
    out = names.select("name")
    order = (("inline", inline), ("env", env), ("store", store), ("default", defaults))
    for label, src in order:
        out = out.join(src.select("name", F.col("value").alias(label)), "name", "left")
    source = F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s, _ in order], F.lit("prompt"))
    return out.select("name", F.coalesce(*[F.col(s) for s, _ in order]).alias("value"), source.alias("source"))


def put_variables(store: DataFrame, new: DataFrame) -> DataFrame:
    """The variable store (scope, name, value) with values set; the new value of a name takes the old one's place."""
    key = ["scope", "name"]
    return store.join(new.select(*key), key, "left_anti").select(*key, "value").unionByName(new.select(*key, "value"))


def drop_variables(store: DataFrame, gone: DataFrame) -> DataFrame:
    """The variable store without the given names (scope, name)."""
    return store.join(gone.select("scope", "name"), ["scope", "name"], "left_anti")


def variable_status(declared: DataFrame, store: DataFrame) -> DataFrame:
    """Where the value of each scope's parameters comes from: scope, name, status (own, global, default, prompt).

    A value stored for the scope comes before the global one, that before a default; values are not shown.
    """
    d = declared.groupBy("scope", "name").agg(F.max("default_value").alias("default_value"))
    own = store.where(F.col("scope") != GLOBAL).select("scope", "name", F.lit(True).alias("own"))
    everywhere = store.where(F.col("scope") == GLOBAL).select("name", F.lit(True).alias("everywhere"))
    d = d.join(own, ["scope", "name"], "left").join(everywhere, "name", "left")
    return d.select("scope", "name", F.when(F.col("own"), "own").when(F.col("everywhere"), "global").when(F.col("default_value").isNotNull(), "default").otherwise("prompt").alias("status"))


def rendered(steps: DataFrame, values: DataFrame) -> DataFrame:
    """Commands with parameters filled in from (name, value) and $$NAME as $NAME; unknown ones stay."""
    filled = values.agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("__m"))
    joined = steps.withColumn("__one", F.lit(1)).join(F.broadcast(filled.withColumn("__one", F.lit(1))), "__one")
    text = F.aggregate(variables(F.col("cmd")), F.col("cmd"), lambda c, n: F.when(F.col("__m")[n].isNull(), c).otherwise(F.regexp_replace(c, F.concat(F.lit(r"(?<!\$)\$"), n, F.lit(r"(?![A-Z0-9_])")), F.regexp_replace(F.col("__m")[n], r"([\\$])", r"\\$1"))))
    return joined.withColumn("cmd", unescape_variables(text)).drop("__m", "__one")


def export_json(steps: DataFrame) -> DataFrame:
    """One document a group: scope, group_name, doc."""
    rows = F.array_sort(F.collect_list(F.struct("step_no", "cmd", "comment")))
    g = steps.groupBy("scope", "group_name").agg(F.max("description").alias("description"), rows.alias("rows"))
    doc = F.struct("description", F.transform("rows", lambda r: F.struct(r["cmd"].alias("cmd"), r["comment"].alias("comment"))).alias("commands"))
    return g.select("scope", "group_name", F.to_json(doc).alias("doc"))


def export_markdown(steps: DataFrame) -> DataFrame:
    """A heading and a table a group: scope, group_name, doc."""
    line = F.concat(F.lit("| `"), F.col("cmd"), F.lit("` | "), F.coalesce("comment", F.lit("")), F.lit(" |"))
    g = steps.withColumn("line", line).groupBy("scope", "group_name").agg(F.array_sort(F.collect_list(F.struct("step_no", "line"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return g.select("scope", "group_name", F.concat(F.lit("## "), "group_name", F.lit("\n\n| Command | Comment |\n|---|---|\n"), body, F.lit("\n")).alias("doc"))


def import_json(docs: DataFrame, fallback: str = "imported") -> DataFrame:
    """Documents (``value``), either of one group or of groups by name, as steps: group_name, description, step_no, cmd, comment."""
    one = F.from_json("value", _DOC)
    many = F.from_json("value", T.MapType(T.StringType(), _DOC))
    single = docs.select(one.alias("d")).where("d.commands is not null").select(F.lit(fallback).alias("group_name"), "d")
    named = docs.where(one["commands"].isNull()).select(F.explode(many).alias("group_name", "d")).where(F.rlike("group_name", F.lit(NAME)))
    rows = single.unionByName(named).select("group_name", F.col("d.description").alias("description"), F.posexplode("d.commands").alias("p", "c"))
    return rows.where("c.cmd <> ''").select("group_name", "description", (F.col("p") + 1).alias("step_no"), F.col("c.cmd").alias("cmd"), F.col("c.comment").alias("comment"))


def import_markdown(docs: DataFrame, fallback: str = "imported") -> DataFrame:
    """Documents (``value``) with ``## name`` headings and tables of backticked commands and comments, as steps."""
    lines = docs.select("value").distinct().select(F.xxhash64("value").alias("doc"), "value").select("doc", F.posexplode(F.split("value", "\r?\n")).alias("p", "line"))
    head = F.regexp_extract("line", r"^##\s+(\S.*?)\s*$", 1)
    cmd, comment = F.regexp_extract("line", r"^\|\s*`([^`]+)`\s*\|", 1), F.regexp_extract("line", r"^\|\s*`[^`]+`\s*\|\s*(.*?)\s*\|?\s*$", 1)
    rows = lines.select("doc", "p", F.when(head != "", head).alias("head"), cmd.alias("cmd"), F.when(comment != "", comment).alias("comment"))
    heads = rows.where("head is not null").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("p", "head"))).alias("heads"))
    steps = rows.where("cmd <> ''").join(heads, "doc", "left")
    above = F.try_element_at(F.filter("heads", lambda h: h["p"] < F.col("p")), F.lit(-1))["head"]
    steps = steps.select("doc", "p", F.coalesce(F.when(F.rlike(above, F.lit(NAME)), above), F.lit(fallback)).alias("group_name"), "cmd", "comment")
    g = steps.groupBy("doc", "group_name").agg(F.array_sort(F.collect_list(F.struct("p", "cmd", "comment"))).alias("rows"))
    return g.select("group_name", F.posexplode("rows").alias("k", "r")).select("group_name", (F.col("k") + 1).alias("step_no"), "r.cmd", "r.comment")


def merge_steps(steps: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """Groups with new steps added (only commands they lack) or put in their place: same columns as ``steps``."""
    key = ["scope", "group_name"]
    if replace:
        return steps.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
    size = steps.groupBy(*key).agg(F.max("step_no").alias("__n"))
    fresh = new.join(steps.select(*key, "cmd"), [*key, "cmd"], "left_anti").join(size, key, "left")
    fresh = fresh.withColumn("step_no", (F.col("step_no") + F.coalesce("__n", F.lit(0))).cast("int")).drop("__n")
    return steps.unionByName(fresh, allowMissingColumns=True)


def rename(steps: DataFrame, scope: str, old: str, new: str) -> DataFrame:
    this = (F.col("scope") == scope) & (F.col("group_name") == old)
    return steps.withColumn("group_name", F.when(this, F.lit(new)).otherwise(F.col("group_name")))


def remove(steps: DataFrame, scope: str, name: str) -> DataFrame:
    return steps.where(~((F.col("scope") == scope) & (F.col("group_name") == name)))


def copy(steps: DataFrame, name: str, source: str, target: str) -> DataFrame:
    """The group also in another scope, in place of one it had there."""
    taken = steps.where((F.col("scope") == source) & (F.col("group_name") == name)).withColumn("scope", F.lit(target))
    return remove(steps, target, name).unionByName(taken)


def last_captured(history: DataFrame, repo: str | None = None) -> DataFrame:
    """The newest non-blank command of a repository (or outside any): command."""
    return history.where(F.col("repo").eqNullSafe(F.lit(repo)) & (F.trim("command") != "")).agg(F.max_by("command", "seq").alias("command"))
