"""Readers of source trees and configuration, and the Python front end."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators.graph import python_rows

EXTENSIONS = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".java": "java"}
EXTRACTED = "path string, kind string, name string, line int, end_line int, owner string, detail string"
FIELDS = [("path", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("owner", pa.string()), ("detail", pa.string())]


#: What the name of a decorator that asks for a login holds; where declared parameters come from.
GUARDS = ("login_required", "auth", "permission", "jwt", "token_required", "admin_required", "roles")
DEFAULTS = {"Query": "query", "Path": "path", "Body": "body", "Header": "header", "Cookie": "cookie", "Form": "form", "File": "file"}


def language_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for extension, language in EXTENSIONS.items():
        out = F.when(F.lower(path).endswith(extension), language).otherwise(out)
    return out


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, language, content) of the source files below ``path``; hidden folders are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = raw.withColumn("language", language_of(F.col("path"))).where(F.col("language").isNotNull() & ~F.col("path").rlike(r"/(\.[^/]+|__pycache__)/"))
    return rows.select("path", "language", F.decode("content", "UTF-8").alias("content"))


def project_language(files: DataFrame) -> DataFrame:
    """The first of Python, JavaScript and Java that occurs."""
    has = lambda x: F.bool_or(F.col("language") == x)
    return files.agg(F.when(has("python"), "python").when(has("javascript"), "javascript").when(has("java"), "java").alias("language"))


def fingerprint(entries: DataFrame, ranges: int = 64) -> DataFrame:
    """SHA-256 of a tree's entries: of the sorted hashes of ``ranges`` parts, each over its sorted
    entries, so no task holds all of them."""
    part = F.substring(F.sha2("entry", 256), 1, 2)
    each = entries.groupBy(F.pmod(F.conv(part, 16, 10).cast("int"), F.lit(ranges)).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("entry")), "\n"), 256).alias("h"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n"), 256).alias("fingerprint"))


def cache_name(path: Column) -> Column:
    """The folder that holds what was made of a source tree."""
    return F.substring(F.sha2(path, 256), 1, 16)


def metadata_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of a project's readme and package files."""
    names = "{README*,readme*,package.json,pom.xml,build.gradle,requirements*.txt,pyproject.toml,setup.py,Dockerfile}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(path)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("content"))


def properties(lines: DataFrame) -> DataFrame:
    """Adds key and value of ``key = value`` lines; comments and others go."""
    kept = lines.where(F.col("line").rlike("^[^:=]+[:=]") & ~F.col("line").rlike("^[#!]"))
    return kept.withColumns({"key": F.regexp_extract("line", "^([^:=]+)[:=]", 1), "value": F.trim(F.regexp_extract("line", "^[^:=]+[:=](.*)$", 1))})


def dependencies(spark: SparkSession, path: str) -> DataFrame:
    """Dependencies of Maven project files."""
    return spark.read.format("xml").option("rowTag", "dependency").schema("groupId string, artifactId string, version string, scope string").load(path)


def python_facts(path: str, content: str):
    """Rows of one Python source: functions, classes, imports, calls, assignments, uses, routes.

    A source that doesn't parse gives one ``error`` row.
    """
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError) as error:
        yield path, "error", type(error).__name__, 0, 0, "", str(error)[:200]
        return

    def walk(node: ast.AST, owner: str):
        for child in ast.iter_child_nodes(node):
            line, end = getattr(child, "lineno", 0), getattr(child, "end_lineno", 0) or 0
            inner = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner = f"{owner}.{child.name}" if owner else child.name
                args = [a.arg for a in child.args.posonlyargs + child.args.args + child.args.kwonlyargs]
                yield path, "function", child.name, line, end, owner, ",".join(args)
                for i, arg in enumerate(args):
                    yield path, "parameter", arg, line, line, inner, str(i)
                given = child.args.posonlyargs + child.args.args
                for arg, value in zip(given[len(given) - len(child.args.defaults) :], child.args.defaults, strict=True):
                    kind = getattr(value.func, "id", "") if isinstance(value, ast.Call) else ""
                    if kind in DEFAULTS:
                        yield path, "route_param", arg.arg, line, line, child.name, DEFAULTS[kind]
                    elif kind in ("Depends", "Security") and any(w in ast.unparse(value).lower() for w in (*GUARDS, "user")):
                        yield path, "route_auth", ast.unparse(value)[:80], line, end, child.name, "dependency"
                for mark in child.decorator_list:
                    word = mark.func if isinstance(mark, ast.Call) else mark
                    word = word.attr if isinstance(word, ast.Attribute) else getattr(word, "id", "")
                    if any(w in word.lower() for w in GUARDS):
                        yield path, "route_auth", word, line, end, child.name, "decorator"
                    if isinstance(mark, ast.Call) and isinstance(mark.func, ast.Attribute) and mark.args and isinstance(mark.args[0], ast.Constant):
                        verb = mark.func.attr
                        if verb == "route":
                            listed = next((k.value for k in mark.keywords if k.arg == "methods"), None)
                            verbs = [e.value for e in listed.elts if isinstance(e, ast.Constant)] if isinstance(listed, (ast.List, ast.Tuple)) else ["GET"]
                        else:
                            verbs = [verb.upper()] if verb in ("get", "post", "put", "delete", "patch", "head", "options") else []
                        for v in verbs:
                            yield path, "route", str(mark.args[0].value), line, end, child.name, v
            elif isinstance(child, ast.ClassDef):
                inner = f"{owner}.{child.name}" if owner else child.name
                yield path, "class", child.name, line, end, owner, ",".join(ast.unparse(b) for b in child.bases)
            elif isinstance(child, ast.Import):
                for a in child.names:
                    yield path, "import", a.name, line, end, owner, a.asname or ""
            elif isinstance(child, ast.ImportFrom):
                for a in child.names:
                    yield path, "import", "." * child.level + (child.module or ""), line, end, owner, a.name
            elif isinstance(child, ast.Call):
                name = child.func.attr if isinstance(child.func, ast.Attribute) else getattr(child.func, "id", "")
                if name:
                    yield path, "call", name, line, end, owner, ast.unparse(child)[:200]
            elif isinstance(child, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                for target in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(target, ast.Name):
                        yield path, "assignment", target.id, line, end, owner, ast.unparse(child)[:120]
            elif isinstance(child, ast.Name) and isinstance(child.ctx, ast.Load):
                yield path, "use", child.id, line, end, owner, ""
            yield from walk(child, inner)

    yield from walk(tree, "")


def extract_python(files: DataFrame) -> DataFrame:
    return python_rows(files, python_facts, EXTRACTED, FIELDS)


def def_use(facts: DataFrame) -> DataFrame:
    """(path, owner, name, line, uses): each assignment or parameter with the lines that read it."""
    defs = facts.where("kind in ('assignment', 'parameter')").select("path", "owner", "name", "line").distinct()
    uses = facts.where("kind = 'use'").select("path", "owner", "name", F.col("line").alias("at")).distinct()
    met = defs.join(uses, ["path", "owner", "name"], "left").where(F.col("at").isNull() | (F.col("at") != F.col("line")))
    return met.groupBy("path", "owner", "name", "line").agg(F.array_sort(F.collect_set("at")).alias("uses"))


def call_edges(facts: DataFrame) -> DataFrame:
    """(path, caller, callee, line, target): calls resolved in their file, else in another."""
    functions = facts.where("kind = 'function'").select(F.col("path").alias("at"), "name").distinct()
    made = facts.where("kind = 'call'").select("path", F.col("owner").alias("caller"), "name", "line").distinct()
    met = made.join(functions, "name", "left")
    best = F.min(F.struct((F.col("at") != F.col("path")).alias("far"), "at")).alias("b")
    return met.groupBy("path", "caller", F.col("name").alias("callee"), "line").agg(best).select("path", "caller", "callee", "line", F.col("b.at").alias("target"))


def sample_sources(spark: SparkSession, names: DataFrame) -> DataFrame:
    """Python sources made from a table of names, to run the front end on."""
    body = F.format_string(
        "import os\n@app.route('/n/%d', methods=['GET', 'POST'])\ndef view_%d(request):\n    q = request.args\n    return run_%d(q)\n\ndef run_%d(q):\n    sql = 'select ' + q\n    return db.execute(sql)\n",
        *["n_nationkey"] * 4,
    )
    return names.select(F.concat(F.lit("app/"), F.lower("n_name"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), body.alias("content"))
