"""``python -m codestrata analyze <path or url>``: one whole analysis; ``query`` reads a stored graph."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import urllib.request
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators import graph, index, parsing, search, site, tiers
from codestrata.session import local_session
from codestrata.sources import files as S
from codestrata.sources import lines

log = logging.getLogger("codestrata")


@dataclass(frozen=True)
class ModelConfig:
    """``none`` (structure only), ``local`` (an endpoint on this machine or network), or ``remote`` (opted into)."""

    mode: str = "none"
    endpoint: str = "http://127.0.0.1:11434/api/generate"
    name: str = "default"
    most_calls: int = 200
    #: A folder of templates; ``prompt.*`` replaces ``tiers.PROMPT``.
    templates: str | None = None
    #: A folder that keeps answers for later runs; by default ``answers`` beside the results where ``mode`` asks a model, none where a function is given.
    answers: str | None = None
    #: Whether prompts show public symbols only.
    public_only: bool = False

    def model(self) -> tiers.Model | None:
        if self.mode == "none":
            return None
        endpoint, name = self.endpoint, self.name
        key = os.environ.get("MODEL_API_KEY") if self.mode == "remote" else None

        def ask(prompt: str) -> str:
            headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
            data = json.dumps({"model": name, "prompt": prompt, "stream": False}).encode()
            with urllib.request.urlopen(urllib.request.Request(endpoint, data, headers), timeout=120) as answer:
                return json.load(answer)["response"]

        return ask


@dataclass
class Analysis:
    """All tables of one run."""

    repository: str
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    nodes: DataFrame
    prompts: DataFrame
    summaries: DataFrame
    errors: DataFrame
    pages: DataFrame


def write_overview(placed: DataFrame, repository: str, path: Path) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    row = tiers.overview(placed, repository).select(F.to_json(F.struct("repository", "modules"), {"ignoreNullFields": "false"}).alias("x")).first()
    part = path.with_suffix(".part")
    part.write_text(row["x"] + "\n")
    os.replace(part, path)


def analyze(spark: SparkSession, given: str, out: str, config: ModelConfig = ModelConfig(), model: tiers.Model | None = None, max_bytes: int = S.MAX_BYTES, max_lines: int = S.MAX_LINES) -> Analysis:
    """Reads, parses, indexes and describes a repository, and replaces what an earlier run left in ``out``."""
    root = S.resolve_input(given)
    repository, target = Path(root).name, Path(out)
    def kept(df: DataFrame, name: str) -> DataFrame:
        """A table of the index directory: written once, read from there by what follows."""
        path = str(target / "indexes" / name)
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    scanned = kept(S.save_structure(S.scan_structure(spark, root), str(target / "indexes/structure.json")), "files")
    log.info("scanned %s", root)
    sources = S.read_sources(spark, root, max_bytes, max_lines)
    skipped = kept(S.left_out(spark, root, max_bytes, max_lines), "left_out")
    if missing := skipped.count():
        log.warning("left out %d files for their size; see %s", missing, target / "indexes/left_out")
    declared = kept(parsing.declarations(sources), "declarations")
    placed = kept(tiers.place(index.register(index.normalise(declared)), scanned, S.manifests(scanned)), "symbols")
    types = kept(index.type_edges(placed, index.imports(declared)), "type_edges")
    edges = kept(index.all_edges(placed, index.imports(declared), types), "edges")
    log.info("indexed %d symbols and %d edges", placed.count(), edges.count())
    nodes = tiers.tier_nodes(placed, repository)
    template = S.load_templates(config.templates).get("prompt", tiers.PROMPT) if config.templates else tiers.PROMPT
    asked = kept(tiers.prompts(tiers.public(placed) if config.public_only else placed, template=template), "prompts")
    ask = model or config.model()
    folder = config.answers or (None if model else str(target.absolute() / "answers"))
    described = kept(tiers.describe(placed, repository), "described")
    summaries, told, left = tiers.attach(nodes, described), None, config.most_calls
    if ask:  # bodies that the model asks for are read where they stand in their files
        offsets = kept(lines.line_offsets(spark, root, max_bytes), "line_offsets")
    for tier in (4, 3, 2, 1) if ask else ():  # what is told of a tier goes into the prompts of the one above
        more = asked if tier == 4 else kept(tiers.prompts_above(summaries, tier, template=template), f"prompts_{tier}")
        answers = kept(tiers.summarise(more, ask, left, name=config.name, folder=folder), f"told_{tier}")
        left -= answers.where("called").count()
        if tier == 4:  # a second pass, with the bodies that the first one asked for
            bodies = kept(tiers.body_prompts(answers, placed, lambda places: lines.read_ranges(places, offsets, root), template=template), "prompts_bodies")
            again = kept(tiers.summarise(bodies, ask, left, name=config.name, folder=folder), "told_bodies")
            left -= again.where("called").count()
            answers = answers.unionByName(again)
        answers = tiers.without_requests(answers)
        told = told.unionByName(answers) if told else answers
        summaries = tiers.attach(nodes, described, told)
    summaries = kept(summaries, "summaries")
    graph_nodes = kept(graph.nodes_of(placed, nodes, summaries), "nodes")
    numbers, terms = graph.node_index(graph_nodes)
    kept(numbers, "node_numbers")
    search.store(terms, str(target / "indexes/node_terms"))
    problems = graph.validate(graph_nodes, edges).limit(20).collect()
    if problems:
        log.warning("graph: %s", "; ".join(f"{p['problem']} {p['id']}" for p in problems))
    write_overview(placed, repository, target / "indexes/structure_overview.json")
    graph.write_graph(graph_nodes, edges, repository, str(target / "graph.json"))
    pages = kept(render(placed, edges, summaries, scanned, index.tests(placed), sources, asked, skipped), "pages")
    site.write_site(pages, str(target / "wiki"))
    log.info("wrote %s", target)
    return Analysis(repository, scanned, placed, edges, graph_nodes, asked, summaries, index.errors(declared), pages)


def render(placed: DataFrame, edges: DataFrame, summaries: DataFrame, scanned: DataFrame, tested: DataFrame, sources: DataFrame, asked: DataFrame, skipped: DataFrame) -> DataFrame:
    """All pages of the site."""
    name = lambda c: T.html_escape(F.coalesce(F.col(c).cast("string"), F.lit("all")))
    totals = tiers.totals(placed)
    count = F.concat(T.html_escape(T.breadcrumb(F.coalesce("module", F.lit("whole repository")), F.col("container"), F.col("component"))), *(x for c in ("n_types", "n_methods", "n_fields") for x in (F.lit(", "), F.col(c).cast("string"), F.lit(f" {c[2:]}"))))
    order = F.struct(F.coalesce("module", F.lit("")), F.coalesce("container", F.lit("")), F.coalesce("component", F.lit("")))
    tech = scanned.groupBy(F.coalesce("language", F.when(F.col("ext") == "", F.lit("other")).otherwise(F.col("ext"))).alias("kind")).agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes")).select(F.concat("kind", F.lit(": "), F.col("n").cast("string"), F.lit(" files, "), F.col("bytes").cast("string"), F.lit(" bytes")).alias("item"))
    tech = tech.unionByName(S.manifests(scanned).select(F.concat(F.lit("build: "), F.col("build"), F.lit(" in "), F.col("path")).alias("item")))
    tech = tech.unionByName(index.stereotypes(placed).groupBy("role").agg(F.count("*").alias("n")).select(F.concat(F.lit("role: "), F.col("role"), F.lit(", "), F.col("n").cast("string")).alias("item")))
    fewer = F.concat(F.lit("prompts: "), F.col("prompt_tokens").cast("string"), F.lit(" estimated tokens for "), F.col("source_tokens").cast("string"), F.lit(" of sources"), F.coalesce(F.concat(F.lit(", "), F.col("percent_less").cast("string"), F.lit(" % less")), F.lit("")))
    tech = tech.unionByName(tiers.reduction(asked, sources).select(fewer.alias("item")))
    tech = tech.unionByName(skipped.select(F.concat(F.lit("left out: "), F.col("path"), F.lit(", "), F.col("reason")).alias("item")))
    matrix = tiers.lift(edges, placed)
    by_module = tested.groupBy("module", "class_id").agg(F.count("*").alias("n"))
    pages = [
        site.view_page("index", "Overview", totals, count, order),
        site.view_page("tech", "Technology", tech, T.html_escape(F.col("item")), F.col("item")),
        site.view_page("tests", "Tests", by_module, F.concat(name("module"), F.lit(": "), name("class_id"), F.lit(", "), F.col("n").cast("string"), F.lit(" tests; coverage not measured")), F.struct("module", "class_id")),
        site.view_page("architecture", "Architecture", tiers.mermaid(matrix), F.concat(F.lit("<pre>"), T.html_escape(F.col("diagram")), F.lit("</pre>")), F.col("diagram")),
        site.module_pages(placed, summaries),
        site.symbol_pages(placed, edges, summaries, sources),
        site.tree_pages(placed),
    ]
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codestrata", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("analyze", help="analyse a local directory or a Git URL")
    run.add_argument("repository")
    run.add_argument("--out", default="output")
    run.add_argument("--mode", choices=("none", "local", "remote"), default="none")
    run.add_argument("--endpoint", default=ModelConfig.endpoint)
    run.add_argument("--model", default=ModelConfig.name)
    run.add_argument("--templates", help="a folder of templates: prompt.txt, with {{system}}, {{context}}, {{structure}} and {{task}}")
    run.add_argument("--answers", help="a folder that keeps the model's answers; what was asked once is not asked again")
    run.add_argument("--most-calls", type=int, default=ModelConfig.most_calls, help="calls of the model that one run may make")
    run.add_argument("--max-bytes", type=int, default=S.MAX_BYTES, help="files with more bytes are not read")
    run.add_argument("--max-lines", type=int, default=S.MAX_LINES, help="files with more lines are not parsed")
    run.add_argument("--public", action="store_true", help="show the model public symbols only")
    ask = commands.add_parser("query", help="relations of a node in a stored graph")
    ask.add_argument("graph")
    ask.add_argument("node")
    ask.add_argument("--kind")
    ask.add_argument("--direction", choices=("out", "in", "both"), default="out")
    find = commands.add_parser("search", help="nodes that some words describe best, in what an analysis has written, and what lies under them")
    find.add_argument("out")
    find.add_argument("terms", nargs="+")
    find.add_argument("--most", type=int, default=5)
    where = commands.add_parser("at", help="the innermost symbols around lines, in what an analysis has written")
    where.add_argument("out")
    where.add_argument("places", nargs="+", metavar="PATH:LINE")
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    spark = SparkSession.getActiveSession() or local_session()
    try:
        if given.command == "analyze":
            analyze(spark, given.repository, given.out, ModelConfig(given.mode, given.endpoint, given.model, given.most_calls, given.templates, given.answers, given.public), max_bytes=given.max_bytes, max_lines=given.max_lines)
        elif given.command == "search":
            nodes, numbers, terms = (spark.read.parquet(f"{given.out}/indexes/{t}") for t in ("nodes", "node_numbers", "node_terms"))
            for row in graph.retrieve(nodes, given.terms, given.most, (numbers, terms)).orderBy("tier", F.desc("score"), "id").toLocalIterator():
                print(row["tier"], row["kind"], row["id"], row["score"])
        elif given.command == "at":
            places = spark.createDataFrame([(p.rpartition(":")[0], int(p.rpartition(":")[2])) for p in given.places], "path string, line long")
            for row in index.enclosing(spark.read.parquet(f"{given.out}/indexes/symbols"), places).orderBy("path", "line").toLocalIterator():
                print(f"{row['path']}:{row['line']}", row["symbolId"], f"lines {row['first']}-{row['last']}")
        else:
            _, edges = S.load_graph(spark, given.graph)
            for row in graph.relations(edges, given.node, given.kind, given.direction).orderBy("kind", "src", "dst").toLocalIterator():
                print(row["src"], row["kind"], row["dst"], "" if row["resolved"] else "(unresolved)")
    except S.InvalidRepository as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


__all__ = ["Analysis", "ModelConfig", "analyze", "main"]
