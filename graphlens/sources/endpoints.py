"""Endpoint rows from the facts of all front ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTRACTORS = ("flask", "fastapi", "django", "express", "spring", "jaxrs")
#: What a file must hold for a framework.
SIGNS = {
    "flask": r"\bfrom flask\b|\bimport flask\b", "fastapi": r"\bfrom fastapi\b|\bimport fastapi\b", "django": r"\bfrom django\b|\bimport django\b",
    "express": r"require\(['\"]express['\"]\)|from ['\"]express['\"]", "spring": r"org\.springframework", "jaxrs": r"(?:javax|jakarta)\.ws\.rs",
}


def frameworks(files: DataFrame) -> DataFrame:
    """(path, framework): those that a file uses."""
    marks = F.array(*[F.when(F.col("content").rlike(SIGNS[n]), n) for n in EXTRACTORS])
    return files.select("path", F.explode(F.array_compact(marks)).alias("framework"))


def django_routes(facts: DataFrame) -> DataFrame:
    """Routes of url lists (calls of path, re_path or url with a route and a view) joined to views by name."""
    call = r"^(?:path|re_path|url)\(r?['\"]([^'\"]*)['\"], *([\w.]+)"
    listed = facts.where("kind = 'call' and name in ('path', 're_path', 'url')").select(
        F.regexp_extract("detail", call, 1).alias("route"), F.regexp_extract("detail", call, 2).alias("view"), F.col("path").alias("listed_in")
    ).where("view <> ''")
    views = facts.where("kind in ('function', 'class')").groupBy("name").agg(F.min(F.struct("path", "line", "end_line")).alias("v"))
    named = listed.withColumn("name", F.element_at(F.split("view", "[.]"), F.when(F.col("view").endswith("as_view"), -2).otherwise(-1)))
    return named.join(views, "name", "left").select(
        F.coalesce("v.path", "listed_in").alias("path"), F.lit("route").alias("kind"), F.concat(F.lit("/"), F.regexp_replace("route", r"^\^|\$$", "")).alias("name"),
        F.coalesce("v.line", F.lit(0)).alias("line"), F.coalesce("v.end_line", F.lit(0)).alias("end_line"), F.col("name").alias("owner"), F.lit("ANY").alias("detail"),
    )


def endpoints(facts: DataFrame) -> DataFrame:
    """(route, methods, handler, file, line, params, auth_required): one row for a handler's route.

    Places of a route in brackets, braces or behind a colon are path parameters; others come from
    the handler's own.
    """
    rows = facts.unionByName(django_routes(facts))
    routes = rows.where("kind = 'route'").groupBy(F.col("path").alias("file"), F.col("name").alias("route"), F.col("owner").alias("handler")).agg(
        F.array_sort(F.collect_set("detail")).alias("methods"), F.min("line").alias("line")
    )
    guards = rows.where("kind = 'route_auth'").select(F.col("path").alias("file"), F.col("owner").alias("handler")).distinct().withColumn("guarded", F.lit(True))
    given = rows.where("kind = 'route_param'").groupBy(F.col("path").alias("file"), F.col("owner").alias("handler")).agg(
        F.array_sort(F.collect_set(F.struct(F.col("name"), F.col("detail").alias("source")))).alias("given")
    )
    places = F.transform(F.regexp_extract_all("route", F.lit(r"[<{](?:\w+:)?(\w+)(?::[^}>]*)?[>}]|:(\w+)"), F.lit(0)), lambda p: F.struct(F.regexp_extract(p, r"(\w+)[>}]?$", 1).alias("name"), F.lit("path").alias("source")))
    none = F.array().cast("array<struct<name:string,source:string>>")
    met = routes.join(guards, ["file", "handler"], "left").join(given, ["file", "handler"], "left")
    return met.select("route", "methods", "handler", "file", "line", F.array_union(places, F.coalesce("given", none)).alias("params"), F.coalesce("guarded", F.lit(False)).alias("auth_required"))
