"""Six tiers (repository, module, container, component, class, method), chunks under a budget, and summaries upwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators import relational as R
from codestrata.operators.answers import ask
from codestrata.operators.folds import chunk_units
from codestrata.operators.index import TYPE_KINDS
from codestrata.sources.files import read_lines

#: A prompt's limit in estimated tokens, and what a summary may have in words.
PROMPT_LIMIT, SUMMARY_WORDS = 1999, 99
#: A method of so many lines or calls is summarised by itself.
LONG_METHOD, MANY_CALLS = 15, 5


def containers(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """``path``, ``container`` (nearest directory above with a manifest, else the root) and its ``type``.

    Every file is joined with its own ancestor directories, an equi join.
    """
    above = files.select("path", F.explode(F.concat(F.array(F.lit("")), F.coalesce(F.transform(T.prefixes(F.col("dir")), lambda p: F.substr(p, F.lit(2))), F.array()))).alias("dir"))
    built = manifests.groupBy("dir").agg(F.min("build").alias("type"))
    nearest = above.join(built, "dir").groupBy("path").agg(F.max_by(F.struct("dir", "type"), F.length("dir")).alias("x"))
    return files.select("path").join(nearest, "path", "left").select("path", F.coalesce("x.dir", F.lit("")).alias("container"), F.coalesce("x.type", F.lit("sources")).alias("type"))


def place(symbols: DataFrame, files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Symbols with their tiers: ``module``, ``container``, ``container_type``, ``component`` and ``class_id``."""
    where = containers(files, manifests).select(F.col("path").alias("filePath"), "container", F.col("type").alias("container_type"))
    first = F.element_at(F.split("container", "/"), 1)
    inside = F.when(F.col("kind").isin(*TYPE_KINDS), F.col("symbolId")).otherwise(F.col("parentSymbolId"))
    return symbols.join(where, "filePath", "left").withColumns({
        "module": F.when(F.coalesce("container", F.lit("")) == "", F.lit("root")).otherwise(first),
        "container": F.when(F.coalesce("container", F.lit("")) == "", F.lit("root")).otherwise(F.col("container")),
        "component": F.when(F.col("package") == "", F.lit("(default)")).otherwise(F.col("package")),
        "class_id": inside,
    })


def _in_order(value, *order):
    """Collected values in a fixed order, since collecting has none."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("k"), value.alias("v")))), lambda x: x["v"])


def overview(placed: DataFrame, repository: str) -> DataFrame:
    """One row: the whole hierarchy without bodies, nested from classes up."""
    methods = placed.where("kind = 'METHOD'").groupBy("class_id").agg(_in_order(T.short_signature(F.col("name"), F.col("signature.parameters")), F.col("range.startLine"), F.col("symbolId")).alias("methods"))
    types = placed.where(F.col("kind").isin(*TYPE_KINDS)).join(methods, "class_id", "left")
    classes = types.select("module", "container", "container_type", "component", F.struct(F.col("symbolId").alias("fqn"), F.coalesce("methods", F.array().cast("array<string>")).alias("methods")).alias("x"))
    components = classes.groupBy("module", "container", "container_type", "component").agg(F.array_sort(F.collect_list("x")).alias("classes"))
    within = components.groupBy("module", "container", "container_type").agg(F.array_sort(F.collect_list(F.struct(F.col("component").alias("name"), "classes"))).alias("components"))
    modules = within.groupBy("module").agg(F.array_sort(F.collect_list(F.struct(F.col("container").alias("name"), F.col("container_type").alias("type"), "components"))).alias("containers"))
    return modules.agg(F.array_sort(F.collect_list(F.struct(F.col("module").alias("name"), "containers"))).alias("modules")).select(F.lit(repository).alias("repository"), "modules")


def tier_nodes(placed: DataFrame, repository: str) -> DataFrame:
    """``tier`` (1 to 6), ``node_id``, ``parent_id`` and ``name`` of every node of the hierarchy."""
    where = F.concat_ws("|", "module", "container")
    component = F.concat_ws("|", "module", "container", "component")
    rows = [
        placed.sparkSession.createDataFrame([(1, repository, None, repository)], "tier int, node_id string, parent_id string, name string"),
        placed.select(F.lit(2).alias("tier"), F.col("module").alias("node_id"), F.lit(repository).alias("parent_id"), F.col("module").alias("name")),
        placed.select(F.lit(3).alias("tier"), where.alias("node_id"), F.col("module").alias("parent_id"), F.col("container").alias("name")),
        placed.select(F.lit(4).alias("tier"), component.alias("node_id"), where.alias("parent_id"), F.col("component").alias("name")),
        placed.where(F.col("kind").isin(*TYPE_KINDS)).select(F.lit(5).alias("tier"), F.col("symbolId").alias("node_id"), component.alias("parent_id"), F.col("name")),
        placed.where("kind = 'METHOD'").select(F.lit(6).alias("tier"), F.col("symbolId").alias("node_id"), F.col("class_id").alias("parent_id"), F.col("name")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r.distinct())
    return out


def totals(placed: DataFrame) -> DataFrame:
    """Types, methods and fields at each tier, and in all."""
    counted = [F.sum((F.col("kind").isin(*kinds)).cast("long")).alias(name) for name, kinds in (("n_types", TYPE_KINDS), ("n_methods", ("METHOD",)), ("n_fields", ("FIELD", "PROPERTY")))]
    return R.roll_up(placed, ["module", "container", "component"], *counted)


def lift(edges: DataFrame, placed: DataFrame, tier: str = "module") -> DataFrame:
    """How often nodes of a tier depend on each other; edges are counted by class before both ends are looked up."""
    where = placed.select(F.col("symbolId").alias("node"), F.col(tier)).distinct()
    joined = edges.where("resolved AND kind <> 'CONTAINS'").join(where.withColumnsRenamed({"node": "src", tier: "src_tier"}), "src").join(where.withColumnsRenamed({"node": "dst", tier: "dst_tier"}), "dst")
    return joined.where("src_tier <> dst_tier").groupBy("src_tier", "dst_tier").agg(F.count("*").alias("n"))


def mermaid(matrix: DataFrame) -> DataFrame:
    """One row: the matrix as the text of a diagram."""
    name = lambda c: F.concat(T.slug(F.col(c)), F.lit('["'), F.col(c), F.lit('"]'))
    line = F.concat(F.lit("  "), name("src_tier"), F.lit(" --> "), name("dst_tier"))
    return matrix.agg(F.concat(F.lit("graph TD\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("diagram"))


def public(placed: DataFrame) -> DataFrame:
    """Public symbols, and members of interfaces and annotations, which need not say so."""
    open_ = placed.where(F.col("kind").isin("INTERFACE", "ANNOTATION")).select(F.col("symbolId").alias("parentSymbolId")).distinct().withColumn("open", F.lit(True))
    joined = placed.join(open_, "parentSymbolId", "left")
    return joined.where(T.has_modifier(F.col("modifiers"), "public") | F.coalesce("open", F.lit(False))).select(*placed.columns)


def skeletons(placed: DataFrame) -> DataFrame:
    """``class_id``, ``place``, ``line`` and ``bare``: the outline of each class, its head first, without bodies.

    ``bare`` is the line without documentation, and with the number of parameters in their place.
    """
    doc = F.when(F.coalesce("docstring", F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" ["), T.cap_words(T.first_sentence(F.concat("docstring", F.lit("."))), 25), F.lit("]")))
    named = F.concat(F.lit("  - "), F.initcap("kind"), F.lit(": "), F.col("name"))
    head = placed.where(F.col("kind").isin(*TYPE_KINDS)).select("class_id", "module", "container", "component", F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit("").alias("c")).alias("place"), F.concat(named, doc).alias("line"), named.alias("bare"))
    inner = placed.where(F.col("kind").isin("METHOD", "FIELD", "PROPERTY") & F.col("class_id").isNotNull())
    shown = F.when(F.col("kind") == "METHOD", T.short_signature(F.col("name"), F.col("signature.parameters"), True)).otherwise(F.concat_ws(" ", "signature.returnType", "name"))
    short = F.when(F.col("kind") == "METHOD", F.concat("name", F.lit("("), F.size("signature.parameters").cast("string"), F.lit(" parameters)"))).otherwise(F.col("name"))
    return head.unionByName(inner.select("class_id", "module", "container", "component", F.struct(F.lit(1).alias("a"), F.col("range.startLine").alias("b"), F.col("symbolId").alias("c")).alias("place"), F.concat(F.lit("    * "), shown, doc).alias("line"), F.concat(F.lit("    * "), short).alias("bare")))


def chunks(placed: DataFrame, budget: int) -> DataFrame:
    """Component skeletons cut at class and member boundaries into chunks of at most ``budget`` estimated tokens.

    See ``folds.chunk_units``. A line over the budget loses its documentation and its
    parameters' types, and only a name that is longer by itself is cut.
    """
    most = budget * T.CHARS_PER_TOKEN - 8
    fitting = F.when(F.length("line") <= most, F.col("line")).otherwise(F.substring("bare", 1, most))
    lines = skeletons(placed).withColumn("line", F.concat(fitting, F.lit("\n")))
    parent = F.concat_ws("|", "module", "container", "component")
    return _cut(lines.select(parent.alias("node_id"), "module", "container", "component", F.struct("class_id", "place").alias("place"), "line"), budget)


def _cut(keyed: DataFrame, budget: int) -> DataFrame:
    """Lines (``node_id``, ``place``, ``line`` and columns of the node) as chunks of a node under the budget."""
    of_node = [c for c in keyed.columns if c not in ("place", "line")]
    packed = chunk_units(keyed, "node_id", "place", T.est_tokens(F.col("line")), budget)
    tokens = F.sum(T.est_tokens(F.col("line"))).alias("tokens")
    return packed.groupBy(*of_node, "chunk").agg(F.array_join(_in_order(F.col("line"), F.col("place")), "").alias("skeleton"), tokens)


SYSTEM = "You are a software architect who explains a code base."
TASK = "Summarise what this part is responsible for in fewer than 100 words, as Markdown bullet points."


#: A prompt's four blocks, by placeholders.
PROMPT = "SYSTEM\n{{system}}\n\nCONTEXT\n{{context}}\n\nSTRUCTURE\n{{structure}}\n\nTASK\n{{task}}"


def _asked(chunked: DataFrame, tier: int, context, template: str) -> DataFrame:
    text = T.fill(template, system=F.lit(SYSTEM), context=context, structure=F.col("skeleton"), task=F.lit(TASK))
    return chunked.select(F.lit(tier).alias("tier"), "node_id", "chunk", text.alias("prompt"), T.est_tokens(text).alias("tokens"))


def _around(template: str) -> int:
    """Estimated tokens of a prompt beside its structure, of which the context takes 820 characters at most."""
    return -(-(len(template) + len(SYSTEM) + len(TASK) + 820) // T.CHARS_PER_TOKEN)


def prompts(placed: DataFrame, limit: int = PROMPT_LIMIT, template: str = PROMPT) -> DataFrame:
    """``tier``, ``node_id``, ``chunk``, ``prompt`` and ``tokens`` of components: four blocks, always below the limit."""
    context = F.concat(F.lit("Module: "), F.substring("module", 1, 200), F.lit(" | Container: "), F.substring("container", 1, 200), F.lit(" | Component: "), F.substring("component", 1, 300), F.lit(" | To read a body first: answer BODY: full.name"))
    return _asked(chunks(placed, limit - _around(template)), 4, context, template)


def prompts_above(summaries: DataFrame, tier: int, limit: int = PROMPT_LIMIT, template: str = PROMPT) -> DataFrame:
    """Prompts for the nodes of a tier (3 to 1) over what has been told of the nodes right below them."""
    most = (limit - _around(template)) * T.CHARS_PER_TOKEN - 8
    told = T.cap_words(F.trim(F.regexp_replace(F.coalesce("summary", F.lit("")), r"\s+", " ")), SUMMARY_WORDS)
    line = F.concat(F.substring(F.concat(F.lit("  - "), F.col("name"), F.lit(": "), told), 1, most), F.lit("\n"))
    keyed = summaries.where(F.col("tier") == tier + 1).select(F.col("parent_id").alias("node_id"), F.struct("name", "node_id").alias("place"), line.alias("line"))
    context = F.concat(F.lit(f"{('Repository', 'Module', 'Container')[tier - 1]}: "), F.substring("node_id", 1, 700))
    return _asked(_cut(keyed, limit - _around(template)), tier, context, template)


def reduction(asked: DataFrame, sources: DataFrame, *by: str) -> DataFrame:
    """Estimated tokens of prompts and of sources, in all or for each of some columns, and by how much prompts are less, in percent."""
    prompts_ = asked.groupBy(*by).agg(F.sum("tokens").alias("prompt_tokens"))
    whole = sources.groupBy(*by).agg(F.sum(T.est_tokens(F.col("text"))).alias("source_tokens"))
    both = (prompts_.join(whole, [*by], "full") if by else prompts_.join(whole, F.lit(True))).fillna(0, ["prompt_tokens", "source_tokens"])
    less = F.when(F.col("source_tokens") > 0, F.round(100 - 100 * F.col("prompt_tokens") / F.col("source_tokens"), 1))
    return both.withColumn("percent_less", less)


#: How an answer asks for the body of a class or method, by its full name or the name inside the component.
REQUEST = r"\bBODY:\s*([\w.$]*[\w$])"


def body_prompts(told: DataFrame, placed: DataFrame, sources: DataFrame | Callable[[DataFrame], DataFrame], limit: int = PROMPT_LIMIT, template: str = PROMPT) -> DataFrame:
    """Prompts with the bodies that answers about components (as of ``summarise``) ask for, and no others.

    ``sources`` are texts, or what reads places (see ``sources.lines``). A name has to be of the same component. Bodies are cut between lines, and lines longer than a prompt inside them.
    """
    most = (limit - _around(template)) * T.CHARS_PER_TOKEN - 8
    asked = told.select("node_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(REQUEST), F.lit(1)))).alias("name"))
    inside = F.concat_ws(".", F.element_at(F.split("node_id", r"\|"), -1), "name")
    wanted = asked.select("node_id", F.explode(F.array_distinct(F.array(F.col("name"), inside))).alias("fullyQualifiedName")).distinct()
    known = placed.select(F.concat_ws("|", "module", "container", "component").alias("node_id"), "fullyQualifiedName", "symbolId", F.col("filePath").alias("path"), F.col("range.startLine").alias("start_line"), F.col("range.endLine").alias("end_line"))
    places = wanted.join(known, ["node_id", "fullyQualifiedName"])
    bodies = sources(places) if callable(sources) else read_lines(sources, places)
    lines = bodies.select("node_id", "symbolId", F.posexplode(F.flatten(F.transform(T.lines_of(F.col("body")), lambda x: F.regexp_extract_all(x, F.lit(f".{{1,{most}}}"), F.lit(0))))).alias("at", "line"))
    keyed = lines.select("node_id", F.struct("symbolId", "at").alias("place"), F.concat("line", F.lit("\n")).alias("line"))
    return _asked(_cut(keyed, limit - _around(template)), 4, F.concat(F.lit("Bodies asked for in "), F.substring("node_id", 1, 700)), template)


def without_requests(told: DataFrame) -> DataFrame:
    """Answers that tell something, rather than ask for a body."""
    return told.where(~F.coalesce(F.col("text").rlike(REQUEST), F.lit(False)))


def describe(placed: DataFrame, repository: str) -> DataFrame:
    """``tier``, ``node_id`` and ``text`` without a model: documentation and counts, from methods up.

    Each tier is told from the tier below, never from sources; the same input gives the same text.
    """
    doc = T.first_sentence(F.concat(F.coalesce("docstring", F.lit("")), F.lit(".")))
    complex_ = (F.col("range.endLine") - F.col("range.startLine") + 1 >= LONG_METHOD) | (F.size("calls") >= MANY_CALLS) | (F.coalesce("docstring", F.lit("")) != "")
    methods = placed.where((F.col("kind") == "METHOD") & complex_).select(F.lit(6).alias("tier"), F.col("symbolId").alias("node_id"), F.when(doc != ".", doc).otherwise(F.concat(F.col("name"), F.lit(" has "), (F.col("range.endLine") - F.col("range.startLine") + 1).cast("string"), F.lit(" lines."))).alias("text"))
    inner = placed.where("kind = 'METHOD'").groupBy(F.col("class_id").alias("node_id")).agg(F.count("*").alias("n"))
    types = placed.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("symbolId").alias("node_id"), F.col("name"), "kind", doc.alias("doc"), F.concat_ws("|", "module", "container", "component").alias("parent"))
    classes = types.join(inner, "node_id", "left").select(F.lit(5).alias("tier"), "node_id", "parent", "name", F.concat(F.when(F.col("doc") != ".", F.concat("doc", F.lit(" "))).otherwise(F.lit("")), F.initcap("kind"), F.lit(" with "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" methods.")).alias("text"))
    below = classes
    out = methods.unionByName(classes.select("tier", "node_id", "text"))
    for tier, unit in ((4, "types"), (3, "components"), (2, "containers"), (1, "modules")):
        head = F.array_join(F.slice(_in_order(F.col("name"), F.col("name"), F.col("node_id")), 1, 5), ", ")
        grouped = below.groupBy(F.col("parent").alias("node_id")).agg(F.concat(F.count("*").cast("string"), F.lit(f" {unit}: "), head, F.lit(".")).alias("text"))
        parts = F.split("node_id", r"\|")
        above = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "|")
        below = grouped.select(F.lit(tier).alias("tier"), "node_id", (F.when(F.size(parts) > 1, above) if tier > 2 else F.lit(repository)).alias("parent"), F.element_at(parts, -1).alias("name"), "text")
        out = out.unionByName(below.select("tier", "node_id", "text"))
    return out


Model = Callable[[str], str]


def summarise(asked: DataFrame, model: Model, most: int, partitions: int = 4, name: str = "", folder: str | None = None) -> DataFrame:
    """``tier``, ``node_id``, ``chunk``, ``text`` and ``called`` from a model, for at most ``most`` calls; see ``answers.ask``."""
    return ask(asked, model, name, most, SUMMARY_WORDS, folder, partitions)


def attach(nodes: DataFrame, described: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """Tier nodes with a ``summary``: the model's where there is one, else the structural one."""
    out = nodes.join(described.withColumnRenamed("text", "structural"), ["tier", "node_id"], "left")
    if told is None:
        return out.withColumn("summary", F.col("structural")).drop("structural")
    joined = told.where("text IS NOT NULL").groupBy("tier", "node_id").agg(F.array_join(_in_order(F.col("text"), F.col("chunk")), "\n").alias("text"))
    return out.join(joined, ["tier", "node_id"], "left").withColumn("summary", F.coalesce("text", "structural")).drop("text", "structural")
