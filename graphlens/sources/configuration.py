"""Java project configuration: Maven files, property and YAML files, web descriptors."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.scalars import version_below
from graphlens.operators.graph import python_rows

SETTING = "path string, kind string, key string, value string"
FIELDS = [(c, pa.string()) for c in ("path", "kind", "key", "value")]
NAMES = "{pom.xml,application*.properties,application*.yml,application*.yaml,bootstrap*.yml,web.xml}"

# Artifacts, and the first version that is not affected (none: every version is listed).
LIBRARIES = (
    ("com.alibaba", "fastjson", "1.2.83", "unsafe deserialisation"), ("commons-collections", "commons-collections", "3.2.2", "deserialisation gadgets"),
    ("org.apache.struts", "struts2-core", None, "several remote code executions in its history"),
    ("org.springframework.boot", "spring-boot-starter-actuator", None, "may expose endpoints of the running system"),
    ("org.apache.commons", "commons-text", "1.10.0", "code execution by interpolation"), ("com.thoughtworks.xstream", "xstream", "1.4.20", "unsafe deserialisation"),
    ("org.yaml", "snakeyaml", "2.0", "unsafe deserialisation"),
)
# Settings, the value that is dangerous (a part of it, or all).
SETTINGS = (
    ("management.endpoints.web.exposure.include", "*", False, "all endpoints of the running system are exposed"),
    ("spring.devtools.restart.enabled", "true", True, "development tools are switched on"), ("spring.security.enabled", "false", True, "security is switched off"),
    ("security.basic.enabled", "false", True, "basic authentication is switched off"), ("endpoints.health.sensitive", "false", True, "health details are not hidden"),
)


def yaml_settings(content: str):
    """Dotted keys of nested ``key: value`` lines, two spaces a level; lists and anchors are not read."""
    stack: list[str] = []
    for line in content.splitlines():
        text = line.strip()
        if not text or text.startswith("#") or ":" not in text:
            continue
        del stack[(len(line) - len(line.lstrip())) // 2 :]
        key, _, value = text.partition(":")
        if value.strip():
            yield ".".join([*stack, key.strip()]), value.strip().strip("\"'")
        else:
            stack.append(key.strip())


def property_settings(content: str):
    for line in content.splitlines():
        found = re.match(r"^([^=:]+?)\s*[=:]\s*(.+?)\s*$", line.strip())
        if found and line.strip()[0] not in "#!":
            yield found[1], found[2]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _children(node: ET.Element) -> dict[str, str]:
    return {_local(c.tag): (c.text or "").strip() for c in node}


def settings(path: str, content: str):
    """(path, kind, key, value) rows: dependency (group:artifact, version), property, servlet and
    secured patterns; an unreadable file is one ``error`` row."""
    name = path.rsplit("/", 1)[-1]
    if name.endswith((".yml", ".yaml")):
        yield from ((path, "property", k, v) for k, v in yaml_settings(content))
    elif name.endswith(".properties"):
        yield from ((path, "property", k, v) for k, v in property_settings(content))
    elif name in ("pom.xml", "web.xml"):
        try:
            tree = ET.fromstring(re.sub(r"<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>", "", content, flags=re.S))
        except ET.ParseError as error:
            yield path, "error", name, str(error)[:200]
            return
        for node in tree.iter():
            kind, inner = _local(node.tag), _children(node)
            if name == "pom.xml" and kind == "dependency":
                yield path, "dependency", f"{inner.get('groupId', '')}:{inner.get('artifactId', '')}", inner.get("version", "")
            elif name == "pom.xml" and kind == "properties":
                yield from ((path, "property", k, v) for k, v in inner.items())
            elif name == "web.xml" and kind in ("servlet-mapping", "filter-mapping"):
                yield path, kind, inner.get("servlet-name") or inner.get("filter-name", ""), inner.get("url-pattern", "")
            elif name == "web.xml" and kind == "security-constraint":
                yield from ((path, "secured", "url-pattern", (x.text or "").strip()) for x in node.iter() if _local(x.tag) == "url-pattern")


def read(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", NAMES).load(path)
    return extract(raw.select("path", F.decode("content", "UTF-8").alias("content")))


def extract(files: DataFrame) -> DataFrame:
    return python_rows(files, settings, SETTING, FIELDS)


def vulnerable(found: DataFrame) -> DataFrame:
    """(path, library, version, fixed_in, reason) of dependencies below a fixed version; versions given
    as ``${name}`` are looked up among the file's properties, unreadable ones count as below."""
    listed = found.sparkSession.createDataFrame([(f"{g}:{a}", v, why) for g, a, v, why in LIBRARIES], "key string, fixed_in string, reason string")
    values = found.where("kind = 'property'").groupBy("path", F.concat(F.lit("${"), "key", F.lit("}")).alias("value")).agg(F.max("value").alias("named"))
    met = found.where("kind = 'dependency'").join(F.broadcast(listed), "key").join(values, ["path", "value"], "left")
    met = met.withColumn("version", F.coalesce("named", "value"))
    return met.where(F.col("fixed_in").isNull() | version_below(F.col("version"), F.col("fixed_in"))).select("path", F.col("key").alias("library"), "version", "fixed_in", "reason")


def dangerous(found: DataFrame) -> DataFrame:
    """(path, key, value, warning) of settings with a dangerous value."""
    listed = found.sparkSession.createDataFrame(list(SETTINGS), "key string, bad string, whole boolean, warning string")
    met = found.where("kind = 'property'").join(F.broadcast(listed), "key")
    value = F.lower("value")
    return met.where(F.when(F.col("whole"), value == F.col("bad")).otherwise(value.contains(F.col("bad")))).select("path", "key", "value", "warning")
