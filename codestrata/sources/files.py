"""Sources: a repository's files as tables, and what earlier runs stored."""

from __future__ import annotations

import json
import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators import relational as R

#: File endings of the languages that are parsed.
LANGUAGES = {"java": "java", "cs": "csharp"}
#: Files that tell how a directory is built, by what they mean.
MANIFESTS = {
    "pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle", "package.json": "npm", "csproj": "dotnet", "sln": "dotnet solution",
    "Dockerfile": "container image", "requirements.txt": "pip", "pyproject.toml": "python", "Cargo.toml": "cargo", "go.mod": "go",
}
#: Files with more bytes are listed but not read.
MAX_BYTES = 2_000_000
#: Files with more lines are not parsed.
MAX_LINES = 50_000


class InvalidRepository(ValueError):
    """The input is neither a readable directory nor a repository that can be cloned."""


def resolve_input(given: str, workspace: str | None = None) -> str:
    """The directory to analyse: a local path, or a fresh shallow clone of a Git URL."""
    if "://" in given or given.startswith("git@"):
        target = tempfile.mkdtemp(prefix="clone-", dir=workspace)
        done = subprocess.run(["git", "clone", "--quiet", "--depth", "1", "--", given, target], capture_output=True, text=True)
        if done.returncode:
            raise InvalidRepository(f"cannot clone {given}: {done.stderr.strip()}")
        return target
    path = Path(given)
    if not path.is_dir():
        raise InvalidRepository(f"{given} is not a directory")
    if not any(path.iterdir()):
        raise InvalidRepository(f"{given} is empty")
    return str(path.resolve())


def _relative(root: str):
    return F.regexp_replace("path", "^(file:)?/*" + "".join(f"\\{c}" if not c.isalnum() and c not in "/_" else c for c in root.strip("/")) + "/", "")


def scan_structure(spark: SparkSession, root: str) -> DataFrame:
    """``path``, ``ext``, ``dir``, ``language`` and ``n_bytes`` of every file; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(_relative(root).alias("path"), F.col("length").alias("n_bytes"))
    files = found.where(~F.col("path").rlike(r"(^|/)\.git/"))
    language = F.coalesce(*(F.when(T.extension(F.col("path")) == e, name) for e, name in LANGUAGES.items()))
    return files.select("path", T.extension(F.col("path")).alias("ext"), T.directory(F.col("path")).alias("dir"), language.alias("language"), "n_bytes")


def directories(files: DataFrame) -> DataFrame:
    """``dir``, its parent, depth, and the number of files in it and below."""
    tree = R.directory_tree(files.where("dir <> ''").select(F.col("dir").alias("path")))
    return tree.select(F.expr("substring(dir, 2)").alias("dir"), T.directory(F.expr("substring(dir, 2)")).alias("parent_dir"), "depth", "n_files")


def read_sources(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, max_lines: int = MAX_LINES) -> DataFrame:
    """``path``, ``language`` and ``text`` of the files that are parsed; the limit of bytes acts before a file is read."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{" + ",".join(LANGUAGES) + "}")
    rows = raw.where(F.col("_metadata.file_size") <= max_bytes).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    rows = rows.select(_relative(root).alias("path"), "text")
    language = F.coalesce(*(F.when(T.extension(F.col("path")) == e, name) for e, name in LANGUAGES.items()))
    rows = rows.where(F.regexp_count("text", F.lit("\n")) < max_lines)
    return rows.select("path", language.alias("language"), F.regexp_replace(F.regexp_replace("text", "^﻿", ""), "\r\n?", "\n").alias("text"))


def left_out(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, max_lines: int = MAX_LINES) -> DataFrame:
    """``path`` and ``reason`` of the files in a known language that ``read_sources`` leaves out for their size."""
    known = F.coalesce(*(F.when(T.extension(F.col("path")) == e, True) for e in LANGUAGES), F.lit(False))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(_relative(root).alias("path"), "length").where(known)
    large = files.where(F.col("length") > max_bytes).select("path", F.concat(F.lit("more bytes than "), F.lit(str(max_bytes))).alias("reason"))
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{" + ",".join(LANGUAGES) + "}").where(F.col("_metadata.file_size") <= max_bytes)
    long_ = raw.where(F.regexp_count("value", F.lit("\n")) >= max_lines).select(F.col("_metadata.file_path").alias("path"))
    return large.unionByName(long_.select(_relative(root).alias("path"), F.concat(F.lit("more lines than "), F.lit(str(max_lines))).alias("reason")))


def manifests(files: DataFrame) -> DataFrame:
    """``dir`` and ``build`` of the files that tell how something is built."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.coalesce(*(F.when((name == m) | F.endswith(name, F.lit(f".{m}")), b) for m, b in MANIFESTS.items()))
    return files.select("dir", "path", kind.alias("build")).where("build IS NOT NULL")


def read_lines(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """The exact lines of what is asked for (``path``, ``start_line``, ``end_line`` and more): texts are joined last."""
    return wanted.join(sources.select("path", "text"), "path").withColumn("body", T.line_range(F.col("text"), F.col("start_line"), F.col("end_line"))).drop("text")


NODE = "id string, kind string, name string, tier int, parent string, path string, startLine int, endLine int, summary string"
EDGE = "src string, dst string, kind string, resolved boolean"
GRAPH = f"schemaVersion string, repository string, nodes array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<{EDGE.replace(' ', ':').replace(',:', ',')}>>"


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a stored graph, also as the views ``nodes`` and ``edges`` for SQL."""
    document = spark.read.schema(GRAPH).json(path, multiLine=True)
    nodes, edges = document.select(F.explode("nodes").alias("x")).select("x.*"), document.select(F.explode("edges").alias("x")).select("x.*")
    nodes.createOrReplaceTempView("nodes")
    edges.createOrReplaceTempView("edges")
    return nodes, edges


def load_overview(spark: SparkSession, path: str) -> DataFrame:
    """A stored overview as rows of module, container, component, class and method."""
    kind = "repository string, modules array<struct<name:string,containers:array<struct<name:string,type:string,components:array<struct<name:string,classes:array<struct<fqn:string,methods:array<string>>>>>>>>>"
    rows = spark.read.schema(kind).json(path, multiLine=True).select("repository", F.explode("modules").alias("m"))
    rows = rows.select("repository", F.col("m.name").alias("module"), F.explode("m.containers").alias("c"))
    rows = rows.select("repository", "module", F.col("c.name").alias("container"), "c.type", F.explode("c.components").alias("p"))
    rows = rows.select("repository", "module", "container", "type", F.col("p.name").alias("component"), F.explode("p.classes").alias("k"))
    return rows.select("repository", "module", "container", "type", "component", F.col("k.fqn").alias("class"), F.explode_outer("k.methods").alias("method"))


def load_templates(folder: str) -> dict[str, str]:
    """Text templates by name without ending."""
    return {p.stem: p.read_text() for p in sorted(Path(folder).glob("*.*")) if p.is_file()}


def save_structure(files: DataFrame, path: str) -> DataFrame:
    """Keeps the inventory for the run, and writes it as one JSON document."""
    kept = files.persist()
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w") as out:
        out.write("[")
        for i, row in enumerate(kept.orderBy("path").toLocalIterator()):
            out.write(("," if i else "") + "\n" + json.dumps(row.asDict(), sort_keys=True))
        out.write("\n]\n")
    return kept
