"""The registered queries over the given tables, and their SQL for DuckDB.

The tables hold no source code, so that each operator runs on a table of the shape it needs; the six tiers of a
repository stand as region, nation, customer, order and line under one root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators import folds, graph, index, search, site, tiers
from codestrata.operators import relational as R
from codestrata.session import cut, table
from codestrata.sources import files as S

MONEY = "decimal(18,2)"
TERMS = ["the", "and", "of", "with", "that"]
HREF = r'href="([^"]*)"'
HEADING = r"<h([1-6])[^>]*>([^<]*)</h[1-6]>"


def q01_url_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.url_host(F.col("url")).alias("host"), T.url_path(F.col("url")).alias("path"))


def q02_directory_tree(spark: SparkSession, d: str) -> DataFrame:
    return R.directory_tree(table(spark, d, "pages").select(T.url_path(F.col("url")).alias("path")))


def q03_line_inventory(spark: SparkSession, d: str) -> DataFrame:
    return R.line_inventory(table(spark, d, "documents"), "doc_id").select("doc_id", "line_no", F.length("line").cast("long").alias("n_chars"))


def q04_line_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.line_range(F.col("text"), 2, 3).alias("fetched"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("dst"))


def q05_link_edges(spark: SparkSession, d: str) -> DataFrame:
    return R.weigh_edges(_links(spark, d), "src", "dst")


def q06_unresolved_links(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "pages").select(T.url_path(F.col("url")).alias("path")).distinct()
    return R.unresolved(_links(spark, d).select("dst").distinct(), paths, "dst", "path")


def _customers(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))


def q07_tier_rollup(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast(MONEY)).alias("price"))
    rows = _customers(spark, d).join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    out = R.roll_up(rows, ["r_name", "n_name", "c_mktsegment"], F.count("*").alias("n_customers"), F.coalesce(F.sum("orders"), F.lit(0)).alias("n_orders"), F.coalesce(F.sum("price").cast("double"), F.lit(0.0)).alias("price"))
    return out.withColumn("grouping", F.col("grouping").cast("long"))


def q08_breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).select("c_custkey", T.breadcrumb(F.col("r_name"), F.col("n_name"), F.col("c_name")).alias("crumb"))


def q09_outline(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return R.outline(rows, "r_name", "n_name")


def q10_bottom_up(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", F.col("o_totalprice").cast("decimal(38,2)").alias("price"))
    rows = orders.join(_customers(spark, d), F.col("o_custkey") == F.col("c_custkey")).select("r_name", "n_name", "c_name", "price")
    return R.bottom_up(rows, ["r_name", "n_name", "c_name"], "price").withColumn("total", F.col("total").cast("double"))


def q11_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.est_tokens(F.col("text")).alias("tokens"))


def q12_pack_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = R.line_inventory(table(spark, d, "documents"), "doc_id")
    return R.pack_units(lines, "doc_id", "line_no", "line", 500)


def q13_degrees(spark: SparkSession, d: str) -> DataFrame:
    return R.degrees(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


def q14_tier_matrix(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum("n").alias("n_edges"))


def q15_closure(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    edges = lines.select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst")).distinct()
    edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    starts = table(spark, d, "part").orderBy("p_partkey").limit(1).select(F.col("p_partkey").alias("node"))
    return R.closure(edges, starts, 3).withColumn("depth", F.col("depth").cast("long"))


def q16_innermost(spark: SparkSession, d: str) -> DataFrame:
    lines = R.line_inventory(table(spark, d, "documents"), "doc_id").select("doc_id", "line_no")
    n = F.size(T.lines_of(F.col("text"))).cast("long")
    half = F.floor(n / 2)
    parts = F.array(
        F.struct(F.lit("whole").alias("name"), F.lit(1).cast("long").alias("first"), n.alias("last")),
        F.struct(F.lit("front").alias("name"), F.lit(1).cast("long").alias("first"), half.alias("last")),
        F.struct(F.lit("third").alias("name"), F.lit(2).cast("long").alias("first"), F.lit(3).cast("long").alias("last")),
    )
    intervals = table(spark, d, "documents").select("doc_id", F.inline(parts))
    return folds.innermost(lines, intervals, "doc_id", "line_no", ["name"])


def q17_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return R.retrieve(table(spark, d, "documents"), "doc_id", "text", TERMS, 20)


def q18_search_index(spark: SparkSession, d: str) -> DataFrame:
    return R.search_index(table(spark, d, "documents"), "doc_id", "text")


def q19_headings(spark: SparkSession, d: str) -> DataFrame:
    html = table(spark, d, "pages").select("page_id", F.regexp_extract_all("html", F.lit(HEADING), 1).alias("levels"), F.regexp_extract_all("html", F.lit(HEADING), 2).alias("titles"))
    each = html.select("page_id", F.posexplode(F.arrays_zip("levels", "titles")).alias("at", "x"))
    return each.select("page_id", (F.col("at") + 1).cast("long").alias("place"), F.col("x.levels").cast("long").alias("level"), F.col("x.titles").alias("title"))


def q20_first_sentence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("summary"))


def q21_word_cap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.cap_words(F.col("text"), 99).alias("capped"))


def q22_duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return R.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


def q23_json_argument(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def q24_html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


def q25_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"))


def q26_union_shapes(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("size"), "lang")
    pages = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.length("html").cast("long").alias("size"))
    return documents.unionByName(pages, allowMissingColumns=True)


def q27_precedence(spark: SparkSession, d: str) -> DataFrame:
    """A supplier for each customer: one that served it, else one of its nation, else one of its region."""
    suppliers = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_regionkey")
    by_nation = suppliers.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("target"))
    by_region = suppliers.groupBy("n_regionkey").agg(F.min("s_suppkey").alias("target"))
    customers = _customers(spark, d).select("c_custkey", "c_nationkey", "r_regionkey")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("target"))
    served = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("rank"), "target")
    near = customers.join(by_nation, F.col("c_nationkey") == F.col("s_nationkey")).select("c_custkey", F.lit(2).alias("rank"), "target")
    far = customers.join(by_region, F.col("r_regionkey") == F.col("n_regionkey")).select("c_custkey", F.lit(3).alias("rank"), "target")
    return R.resolve(served.unionByName(near).unionByName(far), ["c_custkey"], "rank", "target").withColumn("rank", F.col("rank").cast("long"))


def q28_prompts(spark: SparkSession, d: str) -> DataFrame:
    outlines = q09_outline(spark, d)
    prompt = F.concat_ws("\n", F.lit("SYSTEM: describe the structure."), F.concat(F.lit("CONTEXT: "), F.col("r_name")), F.col("outline"), F.lit("TASK: fewer than 100 words."))
    return outlines.select("r_name", prompt.alias("prompt"), T.est_tokens(prompt).alias("tokens"))


def q29_siblings(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return R.neighbours(turns, "conv_id", ["turn"], "role")


def q30_attach_summaries(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("summary"))
    documents = table(spark, d, "documents").select("doc_id", "lang")
    return documents.join(labels, "doc_id", "left").select("doc_id", F.coalesce("summary", F.concat(F.lit("no label, language "), F.col("lang"))).alias("summary"))


def q31_needs_body(spark: SparkSession, d: str) -> DataFrame:
    """Bodies are read only of what is asked for."""
    wanted = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return table(spark, d, "documents").join(wanted, "doc_id", "left_semi").select("doc_id", T.line_range(F.col("text"), 1, 1).alias("head"))


def q32_edge_weights(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"))
    return R.weigh_edges(events, "src", "dst")


def q33_symbol_registry(spark: SparkSession, d: str) -> DataFrame:
    """One row for each content: the smallest id stands for it."""
    documents = table(spark, d, "documents").select("doc_id", F.md5("text").alias("content"), "source")
    return documents.groupBy("content").agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("first"), F.count("*").alias("n")).select("content", "first.doc_id", "first.source", "n")


def q34_tech_inventory(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("n_chars"), F.sum(T.est_tokens(F.col("text"))).alias("tokens"))


def q35_two_way_links(spark: SparkSession, d: str) -> DataFrame:
    """Of each nation, what it refers to and what refers to it."""
    edges = q14_tier_matrix(spark, d)
    names = table(spark, d, "nation").select("n_nationkey", "n_name")
    out = edges.groupBy(F.col("src").alias("n_nationkey")).agg(F.count("*").alias("n_out"), F.sum("n_edges").alias("w_out"))
    into = edges.groupBy(F.col("dst").alias("n_nationkey")).agg(F.count("*").alias("n_in"), F.sum("n_edges").alias("w_in"))
    joined = names.join(out, "n_nationkey", "left").join(into, "n_nationkey", "left")
    return joined.select("n_name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_out", "w_out", "n_in", "w_in")))


def q36_customer_outline(spark: SparkSession, d: str) -> DataFrame:
    """The outline of ``q09_outline`` over tiers that grow with the input."""
    return R.outline(_customers(spark, d), "n_name", "c_name")


def q37_packed_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts over a nation's customers, as many as the budget of lines takes."""
    lines = _customers(spark, d).select("n_name", "c_name", F.concat(F.lit("  - "), F.col("c_name")).alias("line"))
    packed = folds.chunk_units(lines, "n_name", "c_name", T.est_tokens(F.col("line")), 200)
    outline = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_name", "line"))), lambda x: x["line"]), "\n")
    prompt = F.concat_ws("\n", F.lit("SYSTEM: describe the structure."), F.concat(F.lit("CONTEXT: "), F.col("n_name")), F.col("outline"), F.lit("TASK: fewer than 100 words."))
    return packed.groupBy("n_name", "chunk").agg(outline.alias("outline")).select("n_name", "chunk", prompt.alias("prompt"), T.est_tokens(prompt).alias("tokens"))


def q38_requested_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Whole bodies, of what is asked for alone."""
    wanted = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return table(spark, d, "documents").join(wanted, "doc_id", "left_semi").select("doc_id", F.col("text").alias("body"))


def q39_tier_lift(spark: SparkSession, d: str) -> DataFrame:
    """``tiers.lift``: customers depend on suppliers, and so do their nations."""
    edges = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    names = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("module"))
    ends = [table(spark, d, t).select(F.concat(F.lit(x), f"{x}_{k}key").alias("symbolId"), F.col(f"{x}_nationkey").alias("n_nationkey")) for t, x, k in (("customer", "c", "cust"), ("supplier", "s", "supp"))]
    placed = ends[0].unionByName(ends[1]).join(names, "n_nationkey")
    return tiers.lift(edges.withColumns({"kind": F.lit("CALLS"), "resolved": F.lit(True)}), placed, "module")


def _hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of a graph with faults: some nations are missing, and some customers are there twice."""
    key = lambda x, c: F.concat(F.lit(x), F.col(c).cast("string"))
    customers = table(spark, d, "customer").select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent"), "c_custkey")
    parts = [
        table(spark, d, "region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent")),
        table(spark, d, "nation").where("n_nationkey % 7 <> 3").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent")),
        customers.drop("c_custkey"),
        customers.where("c_custkey % 50 = 0").drop("c_custkey"),
        table(spark, d, "orders").select(key("o", "o_orderkey").alias("id"), key("c", "o_custkey").alias("parent")),
    ]
    return reduce(DataFrame.unionByName, parts)


def q40_validate_graph(spark: SparkSession, d: str) -> DataFrame:
    """``graph.validate``: repeated ids, dangling edges, missing parents, and what no root is above."""
    edges = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("c"), (F.col("o_custkey") + 40).cast("string")).alias("dst"), F.lit("EXTENDS").alias("kind"), F.lit(True).alias("resolved"))
    return graph.validate(_hierarchy(spark, d), edges)


def q41_retrieve_graph(spark: SparkSession, d: str) -> DataFrame:
    """``graph.retrieve``: the best customers for some terms, and their orders."""
    top = table(spark, d, "customer").select(F.lit(4).alias("tier"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("summary"))
    inner = table(spark, d, "orders").select(F.lit(5).alias("tier"), F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("parent"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("summary"))
    return graph.retrieve(top.unionByName(inner), ["building", "urgent"], 20).select(F.col("tier").cast("long").alias("tier"), "id", "score")


def q42_call_edges(spark: SparkSession, d: str) -> DataFrame:
    """``index.call_edges``: suppliers are methods that call what they deliver, parts are methods of their brand."""
    method = [F.lit("METHOD").alias("kind")]
    parts = table(spark, d, "part").withColumn("n_args", (F.col("p_size") % 3).cast("int"))
    told = table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(F.collect_set(F.struct(F.col("p_name").alias("name"), "n_args")).alias("calls"))
    takes = lambda n: F.struct(F.array_repeat(F.struct(F.lit("int").alias("type"), F.lit("x").alias("name")), n).alias("parameters")).alias("signature")
    callers = table(spark, d, "supplier").join(told, F.col("s_suppkey") == F.col("l_suppkey")).select(*method, F.concat(F.lit("s"), "s_suppkey").alias("symbolId"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("parentSymbolId"), F.col("s_name").alias("name"), takes(F.lit(0)), "calls")
    called = parts.select(*method, F.concat(F.lit("p"), "p_partkey").alias("symbolId"), F.col("p_brand").alias("parentSymbolId"), F.col("p_name").alias("name"), takes(F.col("n_args")), F.array().cast("array<struct<name:string,n_args:int>>").alias("calls"))
    return index.call_edges(callers.unionByName(called))


def q43_override_edges(spark: SparkSession, d: str) -> DataFrame:
    """``index.override_edges``: suppliers are types below one another, what they deliver are their methods."""
    own = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag").distinct()
    name = F.concat(F.lit("s"), "l_suppkey", F.lit("."), "l_linenumber", F.lit("("), "l_returnflag", F.lit(")"))
    parameters = F.struct(F.array(F.struct(F.col("l_returnflag").alias("type"), F.lit("x").alias("name"))).alias("parameters"))
    methods = own.select(F.lit("METHOD").alias("kind"), name.alias("symbolId"), F.concat(F.lit("s"), "l_suppkey").alias("parentSymbolId"), F.concat(F.lit("m"), "l_linenumber").alias("name"), parameters.alias("signature"))
    return index.override_edges(methods, _suppliers_above(spark, d))


def q44_resolve_names(spark: SparkSession, d: str) -> DataFrame:
    """``index.resolve_names``: customers write the names of parts; brands are packages that they are in or import."""
    brand = lambda key, n: F.concat(F.lit("Brand#"), (F.col(key) % n + 1).cast("string"))
    parts, customers = table(spark, d, "part"), table(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), "c_custkey").alias("path"))
    types = parts.select(F.lit("CLASS").alias("kind"), F.concat_ws(".", "p_brand", "p_name").alias("fullyQualifiedName"), F.col("p_name").alias("name"), F.col("p_brand").alias("package"), F.lit(None).cast("string").alias("parentSymbolId")).distinct()
    bought = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")).select("o_custkey", "p_name").distinct()
    references = bought.select(F.concat(F.lit("c"), "o_custkey").alias("path"), brand("o_custkey", 25).alias("package"), F.concat(F.lit("c"), "o_custkey").alias("src"), F.col("p_name").alias("written"))
    listed = parts.where("p_partkey % 11 = 0").select("p_name").distinct()
    named = bought.where("o_custkey % 10 = 0").join(listed, "p_name").select(F.concat(F.lit("c"), "o_custkey").alias("path"), F.concat_ws(".", brand("o_custkey", 5), "p_name").alias("target"), F.lit(False).alias("is_wildcard"))
    whole = customers.select("path", brand("c_custkey", 7).alias("target"), F.lit(True).alias("is_wildcard"))
    imported = named.unionByName(whole).withColumns({"alias": F.lit(None).cast("string"), "is_static": F.lit(False)})
    return index.resolve_names(references, types, imported).select("src", "written", "dst", "resolved")


def q45_directories(spark: SparkSession, d: str) -> DataFrame:
    """``sources.directories`` over the paths of pages."""
    files = table(spark, d, "pages").select(F.substr(T.url_path(F.col("url")), F.lit(2)).alias("path"))
    return S.directories(files.select("path", T.directory(F.col("path")).alias("dir")))


def q46_read_lines(spark: SparkSession, d: str) -> DataFrame:
    """``sources.read_lines``: some lines of labelled documents."""
    path = F.concat(F.lit("d"), "doc_id").alias("path")
    wanted = table(spark, d, "labels").select(path, (F.col("quality") + 1).alias("start_line"), (F.col("quality") + F.col("toxic") + 3).alias("end_line"))
    return S.read_lines(table(spark, d, "documents").select(path, "text"), wanted).select("path", "body")


def q47_contains_edges(spark: SparkSession, d: str) -> DataFrame:
    """``index.contains_edges``: customers contain orders."""
    return index.contains_edges(table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("symbolId"), F.concat(F.lit("c"), "o_custkey").alias("parentSymbolId")))


def q48_import_edges(spark: SparkSession, d: str) -> DataFrame:
    """``index.import_edges``: customers import the parts that they buy, some of which no brand declares, and a brand."""
    parts = table(spark, d, "part").withColumn("target", F.concat_ws(".", "p_brand", "p_name"))
    types = parts.where("p_size >= 10").select(F.lit("CLASS").alias("kind"), F.col("target").alias("fullyQualifiedName"), F.col("p_name").alias("name"), F.col("p_brand").alias("package"), F.lit(None).cast("string").alias("parentSymbolId"))
    bought = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("c"), "o_custkey").alias("path"), "target")
    whole = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("path"), F.concat(F.lit("Brand#"), (F.col("c_custkey") % 30 + 1).cast("string")).alias("target"))
    return index.import_edges(bought.unionByName(whole), types)


def q49_unresolved_report(spark: SparkSession, d: str) -> DataFrame:
    """``index.unresolved_report`` over the edges of ``q48_import_edges``."""
    return index.unresolved_report(q48_import_edges(spark, d))


def q50_attach_answers(spark: SparkSession, d: str) -> DataFrame:
    """``tiers.attach``: what orders tell of a customer, in their order, else the segment."""
    key = F.concat(F.lit("c"), "c_custkey").alias("node_id")
    customers = table(spark, d, "customer").withColumn("tier", F.lit(4))
    told = table(spark, d, "orders").select(F.lit(4).alias("tier"), F.concat(F.lit("c"), "o_custkey").alias("node_id"), F.col("o_orderkey").alias("chunk"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("text"))
    return tiers.attach(customers.select("tier", key), customers.select("tier", key, F.col("c_mktsegment").alias("text")), told).select("node_id", "summary")


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Customers as types of a segment in a nation of a region, and their orders as methods."""
    where = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tier = [F.col("r_name").alias("module"), F.col("n_name").alias("container"), F.col("c_mktsegment").alias("component"), F.concat(F.lit("c"), "c_custkey").alias("class_id")]
    rest = lambda last: [F.struct(F.lit(1).cast("long").alias("startLine"), last.cast("long").alias("endLine")).alias("range"), F.array().cast("array<string>").alias("calls")]
    types = where.select(*tier, F.lit("CLASS").alias("kind"), F.concat(F.lit("c"), "c_custkey").alias("symbolId"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("docstring"), *rest(F.lit(1)))
    orders = where.join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    methods = orders.select(*tier, F.lit("METHOD").alias("kind"), F.concat(F.lit("o"), "o_orderkey").alias("symbolId"), F.col("o_orderpriority").alias("name"), F.lit(None).cast("string").alias("docstring"), *rest(F.col("o_orderkey") % 40 + 1))
    return types.unionByName(methods)


def q51_tier_nodes(spark: SparkSession, d: str) -> DataFrame:
    """``tiers.tier_nodes``: all nodes of the hierarchy."""
    return tiers.tier_nodes(_placed(spark, d), "all").withColumn("tier", F.col("tier").cast("long"))


def q52_describe(spark: SparkSession, d: str) -> DataFrame:
    """``tiers.describe``: all tiers told from the bottom up, without a model."""
    return tiers.describe(_placed(spark, d), "all").withColumn("tier", F.col("tier").cast("long"))


def q53_dependents(spark: SparkSession, d: str) -> DataFrame:
    """``graph.dependents``: who buys from one supplier, which is the question asked."""
    edges = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.lit("CALLS").alias("kind"), F.lit(True).alias("resolved")).distinct()
    nodes = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("path"), F.lit(1).alias("startLine"), F.lit(1).alias("endLine"))
    return graph.dependents(nodes, edges, "s1").select("src", "dst", "kind", "name", "path")


def q54_search_terms(spark: SparkSession, d: str) -> DataFrame:
    """``site.search_terms`` over addresses of pages."""
    return site.search_terms(table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("rel_path"), F.col("url").alias("title")))


def q55_link_mentions(spark: SparkSession, d: str) -> DataFrame:
    """``site.link_mentions``: texts about parts name kinds of parts, those of some size having a page."""
    name = F.concat(F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(".B"), F.col("p_size").cast("string"))
    parts = table(spark, d, "part")
    texts = parts.select("p_partkey", F.concat(F.lit("<see> "), name, F.lit(".x, "), name, F.lit(". & "), F.col("p_name")).alias("text"))
    return site.link_mentions(texts, "p_partkey", "text", parts.where("p_size >= 10").select(name.alias("target")).distinct(), 1)


def q56_public_symbols(spark: SparkSession, d: str) -> DataFrame:
    """``tiers.public``: customers are public by segment, or as members of nations that are interfaces."""
    nations = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("symbolId"), F.lit(None).cast("string").alias("parentSymbolId"), F.when(F.col("n_regionkey") == 1, "INTERFACE").otherwise("CLASS").alias("kind"), F.lit(None).cast("array<string>").alias("modifiers"))
    modifiers = F.array(F.lit("final"), F.when(F.col("c_mktsegment") == "BUILDING", "public").otherwise("private"))
    customers = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("symbolId"), F.concat(F.lit("n"), "c_nationkey").alias("parentSymbolId"), F.lit("METHOD").alias("kind"), modifiers.alias("modifiers"))
    return tiers.public(nations.unionByName(customers)).select("symbolId", "parentSymbolId")


def _documents_index(spark: SparkSession, d: str) -> DataFrame:
    """How often documents have each word; their ids are their numbers."""
    return search.blocks(search.counted_postings(table(spark, d, "documents").withColumnRenamed("doc_id", "number"), F.lower("text"), "[a-z]{3,}"))


def q57_posting_blocks(spark: SparkSession, d: str) -> DataFrame:
    """``search.blocks``: the index of all documents' words, block by block."""
    found = _documents_index(spark, d)
    gaps = lambda i: F.element_at("gaps", i)
    return found.select("term", "range", "n", "first", "last", "most", gaps(1).alias("first_gap"), gaps(-1).alias("last_gap"), F.aggregate("weights", F.lit(0).cast("long"), lambda a, w: a + w).alias("times"))


def q58_prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    """``search.lookup``: all pages whose address has a word that begins with "ex"."""
    numbers, found = site.title_index(table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("rel_path"), F.col("url").alias("title")))
    return search.lookup(found, "ex").join(numbers, "number").select("term", F.col("rel_path").alias("page"))


def q59_indexed_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """``search.top_k``: the 20 documents in which some words occur most often, by blocks that can reach the 20th score."""
    found = cut(_documents_index(spark, d).where(F.col("term").isin(TERMS)))  # of the index, what is asked for
    best = search.top_k(found, TERMS, 20).best
    return spark.createDataFrame(best, "doc_id long, score long")


def _suppliers_above(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as types, each below the one whose number is a quarter of its own."""
    return table(spark, d, "supplier").where("s_suppkey > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.expr("concat('s', s_suppkey div 4)").alias("dst"), F.lit("EXTENDS").alias("kind"), F.lit(True).alias("resolved"))


def q60_inherited_calls(spark: SparkSession, d: str) -> DataFrame:
    """``index.call_edges`` with inheritance: what suppliers deliver are their methods, and each calls some that it or a supplier above has."""
    said = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.collect_set(F.col("l_partkey") % 900).alias("parts"))  # what both are made of
    takes = F.struct(F.array_repeat(F.struct(F.lit("int").alias("type"), F.lit("x").alias("name")), (F.col("l_linenumber") % 2).cast("int")).alias("parameters")).alias("signature")
    owner, kind = F.concat(F.lit("s"), "l_suppkey").alias("parentSymbolId"), F.lit("METHOD").alias("kind")
    none = F.array().cast("array<struct<name:string,n_args:int>>").alias("calls")
    own = said.groupBy("l_suppkey", (F.col("l_linenumber") % 2).alias("l_linenumber")).agg(F.array_distinct(F.flatten(F.collect_list("parts"))).alias("parts")).select("l_suppkey", "l_linenumber", F.explode("parts").alias("m"))
    methods = own.select(kind, F.concat(F.lit("s"), "l_suppkey", F.lit(".m"), "m", F.lit("/"), "l_linenumber").alias("symbolId"), owner, F.concat(F.lit("m"), "m").alias("name"), takes, none)
    called = F.transform("parts", lambda p: F.struct(F.concat(F.lit("m"), p * 7 % 900).alias("name"), (F.col("l_linenumber") % 2).cast("int").alias("n_args")))
    callers = said.select(kind, F.concat(F.lit("s"), "l_suppkey", F.lit(".c"), "l_linenumber").alias("symbolId"), owner, F.concat(F.lit("c"), "l_linenumber").alias("name"), takes, called.alias("calls"))
    return index.call_edges(methods.unionByName(callers), _suppliers_above(spark, d))


def q61_ancestry(spark: SparkSession, d: str) -> DataFrame:
    """``relational.ancestry``: orders below the next of their customer, customers below their nation, and four nations in a ring."""
    key = lambda x, c: F.concat(F.lit(x), F.col(c).cast("string"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    later = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    chain = orders.select(key("o", "o_orderkey").alias("id"), F.coalesce(F.concat(F.lit("o"), later), key("c", "o_custkey")).alias("parent"))
    customers = table(spark, d, "customer").select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent"))
    ring = table(spark, d, "nation").where("n_nationkey < 4").select(key("n", "n_nationkey").alias("id"), F.concat(F.lit("n"), ((F.col("n_nationkey") + 1) % 4).cast("string")).alias("parent"))
    return R.ancestry(chain.unionByName(customers).unionByName(ring))


def q62_totals(spark: SparkSession, d: str) -> DataFrame:
    """``tiers.totals``: types, methods and fields at each tier."""
    return tiers.totals(_placed(spark, d)).withColumn("grouping", F.col("grouping").cast("long"))


def q63_containers(spark: SparkSession, d: str) -> DataFrame:
    """``tiers.containers``: every page's nearest directory above that some page marks as built."""
    files = table(spark, d, "pages").select("page_id", F.substr(T.url_path(F.col("url")), F.lit(2)).alias("path")).withColumn("dir", T.directory(F.col("path")))
    built = files.where("dir <> ''").select(F.expr("split(dir, '/')[0]").alias("dir"), F.when(F.col("page_id") % 2 == 0, "maven").otherwise("npm").alias("build"))
    deep = files.where("page_id % 5 = 0 AND dir LIKE '%/%'").select("dir", F.lit("gradle").alias("build"))
    return tiers.containers(files.select("path", "dir").distinct(), built.unionByName(deep))


def q64_register(spark: SparkSession, d: str) -> DataFrame:
    """``index.register``: parts in several suppliers' lines are one symbol, under the first place, with what all places say."""
    place = [F.concat(F.lit("s"), "l_suppkey").alias("filePath"), F.struct(F.col("l_orderkey").alias("startLine"), F.col("l_linenumber").alias("endLine")).alias("range")]
    told = [F.when(F.col("l_quantity") > 40, F.col("l_linestatus")).alias("docstring"), F.array("l_returnflag").alias("modifiers")]
    empty = [F.array().cast("array<string>").alias(c) for c in ("annotations", "throws", "extends", "implements", "accessors", "calls", "creates")]
    rows = table(spark, d, "lineitem").dropDuplicates(["l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"]).select(F.concat(F.lit("p"), "l_partkey").alias("symbolId"), *place, *told, *empty)
    rows = rows.withColumn("modifiers", F.array(F.concat(F.lit("m"), F.col("range.endLine").cast("string"))))
    return index.register(rows.drop("docstring").withColumn("docstring", F.when(F.col("range.endLine") % 3 == 0, F.concat("filePath", F.lit(" says"))))).select("symbolId", "filePath", F.col("range.startLine").alias("line"), "docstring", F.array_join(F.sort_array("modifiers"), ",").alias("modifiers"))


def q65_stereotypes(spark: SparkSession, d: str) -> DataFrame:
    """``index.stereotypes``: what the annotations of customers tell, by segment and nation."""
    names = F.array(F.when(F.col("c_mktsegment") == "BUILDING", "Service").when(F.col("c_mktsegment") == "MACHINERY", "Entity").otherwise("Other"), F.when(F.col("c_nationkey") < 5, "Table").otherwise("Route"))
    annotations = F.transform(names, lambda n: F.struct(n.alias("name"))).alias("annotations")
    return index.stereotypes(table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("symbolId"), annotations))


def q66_diagram(spark: SparkSession, d: str) -> DataFrame:
    """``tiers.mermaid`` over the matrix of ``q39_tier_lift``."""
    return tiers.mermaid(q39_tier_lift(spark, d))


def q67_token_reduction(spark: SparkSession, d: str) -> DataFrame:
    """``tiers.reduction``: the first sentence of each document against the whole of it."""
    documents = table(spark, d, "documents").select("doc_id", "text")
    return tiers.reduction(documents.select("doc_id", T.est_tokens(T.first_sentence(F.col("text"))).alias("tokens")), documents, "doc_id")


def q68_annotation_text(spark: SparkSession, d: str) -> DataFrame:
    """``text.annotation_text`` and ``text.annotation_value``: events as annotations with their properties as arguments."""
    number = F.get_json_object("props", "$.k")
    args = F.when(F.col("user_id") % 3 == 0, F.create_map(F.lit("value"), number)).when(F.col("user_id") % 3 == 1, F.create_map(F.lit("of"), F.col("user_id").cast("string"), F.lit("k"), number)).otherwise(F.create_map().cast("map<string,string>"))
    events = table(spark, d, "events").select("event_id", F.struct(F.col("event_type").alias("name"), args.alias("args")).alias("a"))
    return events.select("event_id", T.annotation_text(F.col("a")).alias("shown"), T.annotation_value(F.array("a"), "click").alias("value"))


def q69_symbol_ids(spark: SparkSession, d: str) -> DataFrame:
    """``text.symbol_id`` and ``text.short_signature``: parts as methods whose parameters have generic and dotted types."""
    kinds = F.array(F.lit("java.util.List<String>"), F.concat(F.lit("x.y.B"), F.col("p_size").cast("string")), F.lit("int..."))
    named = F.transform(F.slice(kinds, F.lit(1), F.col("p_size") % 4), lambda t, i: F.struct(t.alias("type"), F.concat(F.lit("p"), i.cast("string")).alias("name")))
    parameters = F.when(F.col("p_size") % 5 != 0, named)
    fqn = F.concat_ws(".", "p_brand", "p_name")
    return table(spark, d, "part").select("p_partkey", T.symbol_id(fqn, parameters).alias("id"), T.short_signature(F.col("p_name"), parameters, True).alias("signature"))


#: The limit of ``q70_prompts_above``, and the tokens of lines that its prompts have room for.
_LIMIT = 700
_ROOM = _LIMIT - tiers._around(tiers.PROMPT)


def q70_prompts_above(spark: SparkSession, d: str) -> DataFrame:
    """``tiers.prompts_above``: prompts about nations over what is told of their customers."""
    told = _customers(spark, d).select(F.lit(4).alias("tier"), F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.col("n_name").alias("parent_id"), F.col("c_name").alias("name"), F.concat_ws(" ", "c_mktsegment", "r_name").alias("summary"))
    return tiers.prompts_above(told, 3, _LIMIT).select("node_id", "chunk", "prompt", "tokens")


QUERIES = {name: f for name, f in sorted(globals().items()) if name[0] == "q" and name[1:3].isdigit()}

_HOST = r"regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
_LINES = "string_split(text, chr(10))"
_EST = "((length({0}) + 3) // 4)"
_CUSTOMERS = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_IMPORTS = """
WITH i AS (
    SELECT 'c' || o_custkey AS src, p_brand || '.' || p_name AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    UNION SELECT 'c' || c_custkey, 'Brand#' || (c_custkey % 30 + 1) FROM customer),
s AS (SELECT p_brand, p_brand || '.' || p_name AS name FROM part WHERE p_size >= 10)
SELECT src, dst, 'IMPORTS' AS kind, dst IN (SELECT name FROM s) OR dst IN (SELECT p_brand FROM s) AS resolved FROM i"""
_LINKS = f"SELECT page_id AS src, unnest(regexp_extract_all(html, '{HREF}', 1)) AS dst FROM pages"
_OUTLINE = "SELECT r_name, '+ ' || r_name || chr(10) || string_agg('  - ' || n_name, chr(10) ORDER BY n_name) AS outline FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"
_MATRIX = "SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n_edges FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"

ORACLE_SQL = {
    "q01_url_parts": f"SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages",
    "q02_directory_tree": f"""
WITH parts AS (SELECT list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS p FROM pages),
each AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM parts)
SELECT '/' || array_to_string(list_slice(p, 1, i), '/') AS dir, i AS depth, count(*) AS n_files FROM each GROUP BY ALL""",
    "q03_line_inventory": f"""
WITH each AS (SELECT doc_id, unnest({_LINES}) AS line, unnest(range(1, len({_LINES}) + 1)) AS line_no FROM documents)
SELECT doc_id, line_no, length(line) AS n_chars FROM each""",
    "q04_line_range": f"SELECT doc_id, coalesce(array_to_string(list_slice({_LINES}, 2, 3), chr(10)), '') AS fetched FROM documents",
    "q05_link_edges": f"SELECT src, dst, count(*) AS n FROM ({_LINKS}) GROUP BY ALL",
    "q06_unresolved_links": f"SELECT DISTINCT dst FROM ({_LINKS}) WHERE dst NOT IN (SELECT {_PATH} FROM pages)",
    "q07_tier_rollup": f"""
WITH o AS (SELECT o_custkey, count(*) AS orders, sum(o_totalprice::DECIMAL(18,2)) AS price FROM orders GROUP BY 1)
SELECT r_name, n_name, c_mktsegment, count(*) AS n_customers, coalesce(sum(orders), 0)::BIGINT AS n_orders, coalesce(sum(price)::DOUBLE, 0.0) AS price, grouping_id(r_name, n_name, c_mktsegment) AS grouping
FROM {_CUSTOMERS} LEFT JOIN o ON c_custkey = o_custkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""",
    "q08_breadcrumbs": f"SELECT c_custkey, concat_ws(' > ', r_name, n_name, c_name) AS crumb FROM {_CUSTOMERS}",
    "q09_outline": _OUTLINE,
    "q10_bottom_up": f"""
WITH rows AS (SELECT r_name, n_name, c_name, o_totalprice::DECIMAL(38,2) AS price FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey)
SELECT 1 AS tier, r_name AS node, sum(price)::DOUBLE AS total FROM rows GROUP BY r_name
UNION ALL SELECT 2, n_name, sum(price)::DOUBLE FROM rows GROUP BY r_name, n_name
UNION ALL SELECT 3, c_name, sum(price)::DOUBLE FROM rows GROUP BY r_name, n_name, c_name""",
    "q11_token_estimate": f"SELECT doc_id, {_EST.format('text')} AS tokens FROM documents",
    "q12_pack_lines": f"""
WITH RECURSIVE units AS (SELECT doc_id, unnest(range(1, len({_LINES}) + 1)) AS line_no, unnest({_LINES}) AS line FROM documents),
sized AS (SELECT doc_id, line_no, {_EST.format('line')} AS n FROM units),
walk(doc_id, line_no, chunk, used) AS (
    SELECT doc_id, line_no, 0::BIGINT, n::BIGINT FROM sized WHERE line_no = 1
    UNION ALL SELECT s.doc_id, s.line_no, CASE WHEN used + n > 500 THEN chunk + 1 ELSE chunk END, CASE WHEN used + n > 500 THEN n ELSE used + n END
    FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.line_no = w.line_no + 1)
SELECT doc_id, chunk, count(*) AS n_units, sum(n)::BIGINT AS tokens FROM walk JOIN sized USING (doc_id, line_no) GROUP BY ALL""",
    "q13_degrees": """
SELECT coalesce(a.node, b.node) AS node, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree
FROM (SELECT l_suppkey AS node, count(*) AS o FROM lineitem GROUP BY 1) a FULL JOIN (SELECT l_partkey AS node, count(*) AS i FROM lineitem GROUP BY 1) b ON a.node = b.node""",
    "q14_tier_matrix": _MATRIX,
    "q15_closure": """
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, -l_suppkey AS dst FROM lineitem), edges AS (SELECT * FROM e UNION ALL SELECT dst, src FROM e),
walk(node, depth) AS (
    SELECT min(p_partkey), 0::BIGINT FROM part UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 3)
SELECT node, min(depth) AS depth FROM walk GROUP BY node""",
    "q16_innermost": f"""
WITH counted AS (SELECT doc_id, len({_LINES}) AS n FROM documents),
points AS (SELECT doc_id, unnest(range(1, n + 1)) AS line_no FROM counted),
intervals AS (
    SELECT doc_id, 'whole' AS name, 1 AS first, n AS last FROM counted UNION ALL SELECT doc_id, 'front', 1, n // 2 FROM counted UNION ALL SELECT doc_id, 'third', 2, 3 FROM counted),
ranked AS (
    SELECT doc_id, line_no, name, first, last, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY last - first, name) AS r
    FROM points JOIN intervals USING (doc_id) WHERE line_no BETWEEN first AND last)
SELECT doc_id, line_no, name, first::BIGINT AS first, last::BIGINT AS last FROM ranked WHERE r = 1""",
    "q17_retrieve": f"""
SELECT doc_id, len(list_intersect(list_distinct(string_split_regex(lower(text), '[^a-z]+')), {TERMS}))::BIGINT AS score
FROM documents ORDER BY score DESC, doc_id LIMIT 20""",
    "q18_search_index": """
WITH terms AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '([a-z]{3,})', 1))) AS term FROM documents)
SELECT term, count(*) AS n_texts FROM terms GROUP BY term""",
    "q19_headings": f"""
WITH each AS (
    SELECT page_id, unnest(regexp_extract_all(html, '{HEADING}', 1)) AS level, unnest(regexp_extract_all(html, '{HEADING}', 2)) AS title,
        unnest(range(1, len(regexp_extract_all(html, '{HEADING}', 1)) + 1)) AS place FROM pages)
SELECT page_id, place, level::BIGINT AS level, title FROM each""",
    "q20_first_sentence": "SELECT doc_id, regexp_extract(text, '^([^.!?]*[.!?])', 1) AS summary FROM documents",
    "q21_word_cap": r"SELECT doc_id, array_to_string(list_slice(string_split_regex(text, '\s+'), 1, 99), ' ') AS capped FROM documents",
    "q22_duplicate_ids": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "q23_json_argument": "SELECT event_id, props->>'$.k' AS k FROM events",
    "q24_html_escape": "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages",
    "q25_content_hash": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "q26_union_shapes": "SELECT 'document' AS kind, doc_id AS id, length(text) AS size, lang FROM documents UNION ALL SELECT 'page', page_id, length(html), NULL FROM pages",
    "q27_precedence": f"""
WITH s AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
candidates AS (
    SELECT o_custkey AS c_custkey, 1 AS rank, l_suppkey AS target FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    UNION ALL SELECT c_custkey, 2, min(s_suppkey) FROM customer JOIN s ON c_nationkey = s_nationkey GROUP BY c_custkey
    UNION ALL SELECT c_custkey, 3, min(s_suppkey) FROM {_CUSTOMERS} JOIN s ON s.n_regionkey = r_regionkey GROUP BY c_custkey),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY rank, target) AS r FROM candidates)
SELECT c_custkey, rank::BIGINT AS rank, target FROM ranked WHERE r = 1""",
    "q28_prompts": f"""
WITH p AS (SELECT r_name, concat_ws(chr(10), 'SYSTEM: describe the structure.', 'CONTEXT: ' || r_name, outline, 'TASK: fewer than 100 words.') AS prompt FROM ({_OUTLINE}))
SELECT r_name, prompt, {_EST.format('prompt')} AS tokens FROM p""",
    "q29_siblings": "SELECT conv_id, turn, role, lag(role) OVER w AS previous, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "q30_attach_summaries": "SELECT doc_id, coalesce('quality ' || quality, 'no label, language ' || lang) AS summary FROM documents LEFT JOIN labels USING (doc_id)",
    "q31_needs_body": f"SELECT doc_id, array_to_string(list_slice({_LINES}, 1, 1), chr(10)) AS head FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "q32_edge_weights": "SELECT user_id AS src, event_type AS dst, count(*) AS n FROM events GROUP BY ALL",
    "q33_symbol_registry": "SELECT md5(text) AS content, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS n FROM documents GROUP BY 1",
    "q34_tech_inventory": f"SELECT lang, source, count(*) AS n_files, sum(n_chars)::BIGINT AS n_chars, sum({_EST.format('text')})::BIGINT AS tokens FROM documents GROUP BY ALL",
    "q35_two_way_links": f"""
WITH m AS ({_MATRIX}), o AS (SELECT src, count(*) AS n, sum(n_edges)::BIGINT AS w FROM m GROUP BY 1), i AS (SELECT dst, count(*) AS n, sum(n_edges)::BIGINT AS w FROM m GROUP BY 1)
SELECT n_name, coalesce(o.n, 0) AS n_out, coalesce(o.w, 0) AS w_out, coalesce(i.n, 0) AS n_in, coalesce(i.w, 0) AS w_in FROM nation LEFT JOIN o ON n_nationkey = src LEFT JOIN i ON n_nationkey = dst""",
    "q36_customer_outline": f"SELECT n_name, '+ ' || n_name || chr(10) || string_agg('  - ' || c_name, chr(10) ORDER BY c_name) AS outline FROM {_CUSTOMERS} GROUP BY n_name",
    "q37_packed_prompts": f"""
WITH RECURSIVE lines AS (SELECT n_name, row_number() OVER (PARTITION BY n_name ORDER BY c_name) AS line_no, '  - ' || c_name AS line FROM {_CUSTOMERS}),
sized AS (SELECT *, {_EST.format('line')} AS n FROM lines),
walk(n_name, line_no, chunk, used) AS (
    SELECT n_name, line_no, 0::BIGINT, n::BIGINT FROM sized WHERE line_no = 1
    UNION ALL SELECT s.n_name, s.line_no, CASE WHEN used + n > 200 THEN chunk + 1 ELSE chunk END, CASE WHEN used + n > 200 THEN n ELSE used + n END
    FROM walk w JOIN sized s ON s.n_name = w.n_name AND s.line_no = w.line_no + 1),
p AS (
    SELECT n_name, chunk, concat_ws(chr(10), 'SYSTEM: describe the structure.', 'CONTEXT: ' || n_name, string_agg(line, chr(10) ORDER BY line_no), 'TASK: fewer than 100 words.') AS prompt
    FROM walk JOIN sized USING (n_name, line_no) GROUP BY n_name, chunk)
SELECT n_name, chunk, prompt, {_EST.format('prompt')} AS tokens FROM p""",
    "q38_requested_bodies": "SELECT doc_id, text AS body FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "q39_tier_lift": """
WITH e AS (SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT a.n_name AS src_tier, b.n_name AS dst_tier, count(*) AS n
FROM e JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey
WHERE a.n_name <> b.n_name GROUP BY ALL""",
    "q40_validate_graph": """
WITH nodes AS (
    SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation WHERE n_nationkey % 7 <> 3
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer WHERE c_custkey % 50 = 0
    UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
missing AS (SELECT id FROM nodes WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM nodes)),
ends AS (SELECT 'o' || o_orderkey AS id FROM orders UNION SELECT 'c' || (o_custkey + 40) FROM orders)
SELECT 'repeated id' AS problem, id FROM nodes GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'dangling edge', id FROM ends WHERE id NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'missing parent', id FROM missing
UNION ALL SELECT DISTINCT 'no root above', 'o' || o_orderkey FROM orders WHERE 'c' || o_custkey IN (SELECT id FROM missing)""",
    "q41_retrieve_graph": """
WITH best AS (SELECT 4 AS tier, 'c' || c_custkey AS id, 1 AS score FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY id LIMIT 20)
SELECT tier::BIGINT AS tier, id, score::BIGINT AS score FROM best
UNION ALL SELECT 5, 'o' || o_orderkey, (o_orderpriority = '1-URGENT')::BIGINT FROM orders WHERE 'c' || o_custkey IN (SELECT id FROM best)""",
    "q42_call_edges": """
WITH calls AS (SELECT DISTINCT l_suppkey AS s, p_name AS name, p_size % 3 AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
methods AS (
    SELECT 'p' || p_partkey AS dst, p_brand AS owner, p_name AS name, p_size % 3 AS n FROM part
    UNION ALL SELECT DISTINCT 's' || s_suppkey, 'Brand#' || (s_suppkey % 25 + 1), s_name, 0 FROM supplier JOIN lineitem ON l_suppkey = s_suppkey),
own AS (SELECT s, c.name, c.n, dst FROM calls c JOIN methods m ON m.owner = 'Brand#' || (s % 25 + 1) AND m.name = c.name AND m.n = c.n),
named AS (SELECT name, n, min(dst) AS dst, count(*) AS k FROM methods GROUP BY ALL),
rest AS (SELECT c.* FROM calls c ANTI JOIN own o ON c.s = o.s AND c.name = o.name AND c.n = o.n)
SELECT 's' || s AS src, dst, 'CALLS' AS kind, true AS resolved FROM own
UNION SELECT 's' || s, CASE WHEN k = 1 THEN dst ELSE name || '/' || n END, 'CALLS', k = 1 FROM rest JOIN named USING (name, n)""",
    "q43_override_edges": """
WITH RECURSIVE up(type, above) AS (SELECT s_suppkey, s_suppkey // 4 FROM supplier WHERE s_suppkey > 0 UNION SELECT type, above // 4 FROM up WHERE above > 0),
m AS (SELECT DISTINCT l_suppkey AS s, l_linenumber AS n, l_returnflag AS f FROM lineitem)
SELECT DISTINCT 's' || a.s || '.' || a.n || '(' || a.f || ')' AS src, 's' || b.s || '.' || b.n || '(' || b.f || ')' AS dst, 'OVERRIDES' AS kind, true AS resolved
FROM up JOIN m a ON a.s = type JOIN m b ON b.s = above AND b.n = a.n AND b.f = a.f""",
    "q44_resolve_names": """
WITH w AS (SELECT DISTINCT o_custkey AS c, p_name AS written FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
t AS (SELECT DISTINCT p_brand, p_name FROM part),
found AS (
    SELECT c, written, 1 AS rank, 'Brand#' || (c % 5 + 1) || '.' || written AS target FROM w WHERE c % 10 = 0 AND written IN (SELECT p_name FROM part WHERE p_partkey % 11 = 0)
    UNION ALL SELECT c, written, 3, p_brand || '.' || p_name FROM w JOIN t ON p_name = written AND p_brand = 'Brand#' || (c % 25 + 1)
    UNION ALL SELECT c, written, 4, p_brand || '.' || p_name FROM w JOIN t ON p_name = written AND p_brand = 'Brand#' || (c % 7 + 1) WHERE c IN (SELECT c_custkey FROM customer)),
best AS (SELECT c, written, arg_min(target, rank) AS target FROM found GROUP BY ALL)
SELECT 'c' || c AS src, written, coalesce(target, written) AS dst, coalesce(target, written) IN (SELECT p_brand || '.' || p_name FROM part) AS resolved FROM w LEFT JOIN best USING (c, written)""",
    "q45_directories": f"""
WITH f AS (SELECT list_filter(string_split(regexp_extract(substr({_PATH}, 2), '^(.*)/[^/]*$', 1), '/'), lambda x: x <> '') AS p FROM pages),
each AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM f)
SELECT array_to_string(list_slice(p, 1, i), '/') AS dir, coalesce(array_to_string(list_slice(p, 1, i - 1), '/'), '') AS parent_dir, i AS depth, count(*) AS n_files FROM each GROUP BY ALL""",
    "q46_read_lines": f"SELECT 'd' || doc_id AS path, coalesce(array_to_string(list_slice({_LINES}, quality + 1, quality + toxic + 3), chr(10)), '') AS body FROM labels JOIN documents USING (doc_id)",
    "q47_contains_edges": "SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'CONTAINS' AS kind, true AS resolved FROM orders",
    "q48_import_edges": _IMPORTS,
    "q49_unresolved_report": f"SELECT kind, dst, count(*) AS n FROM ({_IMPORTS}) WHERE NOT resolved GROUP BY ALL",
    "q50_attach_answers": """
WITH told AS (SELECT o_custkey, string_agg(o_orderpriority, chr(10) ORDER BY o_orderkey) AS text FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT 'c' || c_custkey AS node_id, coalesce(text, c_mktsegment) AS summary FROM customer LEFT JOIN told ON o_custkey = c_custkey""",
    "q51_tier_nodes": f"""
WITH t AS (SELECT *, concat_ws('|', r_name, n_name, c_mktsegment) AS component FROM {_CUSTOMERS})
SELECT 1::BIGINT AS tier, 'all' AS node_id, NULL AS parent_id, 'all' AS name
UNION SELECT 2, r_name, 'all', r_name FROM t UNION SELECT 3, r_name || '|' || n_name, r_name, n_name FROM t
UNION SELECT 4, component, r_name || '|' || n_name, c_mktsegment FROM t UNION SELECT 5, 'c' || c_custkey, component, c_name FROM t
UNION SELECT 6, 'o' || o_orderkey, 'c' || o_custkey, o_orderpriority FROM orders JOIN t ON o_custkey = c_custkey""",
    "q52_describe": f"""
WITH t AS (SELECT *, concat_ws('|', r_name, n_name, c_mktsegment) AS component FROM {_CUSTOMERS}),
m AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
told AS (
    SELECT 4 AS tier, component AS node_id, 'types' AS unit, c_name AS name FROM t
    UNION ALL SELECT DISTINCT 3, r_name || '|' || n_name, 'components', c_mktsegment FROM t
    UNION ALL SELECT DISTINCT 2, r_name, 'containers', n_name FROM t UNION ALL SELECT DISTINCT 1, 'all', 'modules', r_name FROM t)
SELECT tier::BIGINT AS tier, node_id, count(*) || ' ' || unit || ': ' || array_to_string(list_slice(list(name ORDER BY name), 1, 5), ', ') || '.' AS text FROM told GROUP BY tier, node_id, unit
UNION ALL SELECT 5, 'c' || c_custkey, c_mktsegment || '. Class with ' || coalesce(n, 0) || ' methods.' FROM t LEFT JOIN m ON o_custkey = c_custkey
UNION ALL SELECT 6, 'o' || o_orderkey, o_orderpriority || ' has ' || (o_orderkey % 40 + 1) || ' lines.' FROM orders JOIN t ON o_custkey = c_custkey WHERE o_orderkey % 40 + 1 >= 15""",
    "q53_dependents": """
SELECT DISTINCT 'c' || o_custkey AS src, 's1' AS dst, 'CALLS' AS kind, c_name AS name, c_mktsegment AS path
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE l_suppkey = 1""",
    "q54_search_terms": r"""
WITH w AS (SELECT page_id, unnest(list_distinct(regexp_split_to_array(lower(regexp_replace(url, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'))) AS term FROM pages)
SELECT term, count(DISTINCT page_id) AS n_pages, min('p' || page_id) AS first_page FROM w WHERE length(term) > 1 GROUP BY term""",
    "q55_link_mentions": """
WITH t AS (SELECT *, replace(p_type, ' ', '_') || '.B' || p_size AS name FROM part)
SELECT p_partkey, '&lt;see&gt; ' || name || '.x, ' || CASE WHEN p_size >= 10 THEN '<a href="../symbols/' || lower(name) || '-' || left(md5(name), 6) || '.html">' || name || '</a>' ELSE name END || '. &amp; ' || p_name AS text FROM t""",
    "q56_public_symbols": """
SELECT 'c' || c_custkey AS symbolId, 'n' || c_nationkey AS parentSymbolId FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' OR n_regionkey = 1""",
    "q57_posting_blocks": """
WITH words AS (SELECT doc_id AS number, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents),
posted AS (SELECT term, number, count(*) AS weight FROM words GROUP BY ALL),
gaps AS (SELECT *, number // 4096 AS range, number - coalesce(lag(number) OVER w, number // 4096 * 4096) AS gap FROM posted WINDOW w AS (PARTITION BY term, number // 4096 ORDER BY number))
SELECT term, range, count(*) AS n, min(number) AS first, max(number) AS last, max(weight) AS most, arg_min(gap, number) AS first_gap, arg_max(gap, number) AS last_gap, sum(weight)::BIGINT AS times
FROM gaps GROUP BY term, range""",
    "q58_prefix_lookup": r"""
WITH w AS (SELECT page_id, unnest(regexp_split_to_array(lower(regexp_replace(url, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+')) AS term FROM pages)
SELECT DISTINCT term, 'p' || page_id AS page FROM w WHERE term LIKE 'ex%'""",
    "q59_indexed_retrieval": f"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS term FROM documents)
SELECT doc_id, count(*) AS score FROM words WHERE list_contains({TERMS}, term) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""",
    "q60_inherited_calls": """
WITH RECURSIVE up(type, above, depth) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION ALL SELECT type, above // 4, depth + 1 FROM up WHERE above > 0),
m AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 900 AS k, l_linenumber % 2 AS n, 's' || l_suppkey || '.m' || (l_partkey % 900) || '/' || (l_linenumber % 2) AS dst FROM lineitem),
calls AS (SELECT DISTINCT l_suppkey AS s, 's' || l_suppkey || '.c' || l_linenumber AS src, l_partkey * 7 % 900 AS k, l_linenumber % 2 AS n FROM lineitem),
own AS (SELECT c.s, c.k, c.n, arg_min(dst, depth) AS dst FROM (SELECT DISTINCT s, k, n FROM calls) c JOIN up ON type = c.s JOIN m ON m.s = above AND m.k = c.k AND m.n = c.n GROUP BY ALL),
named AS (SELECT k, n, count(*) AS many, min(dst) AS dst FROM m GROUP BY ALL)
SELECT DISTINCT src, coalesce(o.dst, CASE WHEN many = 1 THEN named.dst ELSE 'm' || c.k || '/' || c.n END) AS dst, 'CALLS' AS kind, o.dst IS NOT NULL OR many = 1 AS resolved
FROM calls c JOIN named ON named.k = c.k AND named.n = c.n LEFT JOIN own o ON o.s = c.s AND o.k = c.k AND o.n = c.n""",
    "q61_ancestry": """
WITH o AS (SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS steps FROM orders),
rows AS (
    SELECT 'o' || o_orderkey AS id, steps + 1 AS depth, c_nationkey AS n, true AS known FROM o JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT 'o' || o_orderkey, steps, NULL, false FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'c' || c_custkey, 1, c_nationkey, true FROM customer
    UNION ALL SELECT 'n' || n_nationkey, 0, n_nationkey, true FROM nation WHERE n_nationkey < 4)
SELECT id, CASE WHEN n >= 4 THEN 'n' || n END AS top, CASE WHEN n >= 4 THEN depth END AS depth, CASE WHEN n < 4 THEN 'n0' END AS cycle FROM rows WHERE known""",
    "q62_totals": f"""
WITH t AS (
    SELECT r_name AS module, n_name AS container, c_mktsegment AS component, 1 AS t, 0 AS m FROM {_CUSTOMERS}
    UNION ALL SELECT r_name, n_name, c_mktsegment, 0, 1 FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey)
SELECT module, container, component, sum(t)::BIGINT AS n_types, sum(m)::BIGINT AS n_methods, 0::BIGINT AS n_fields, grouping_id(module, container, component) AS grouping FROM t GROUP BY ROLLUP (module, container, component)""",
    "q63_containers": f"""
WITH f AS (SELECT page_id, substr({_PATH}, 2) AS path FROM pages),
files AS (SELECT page_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM f),
built AS (
    SELECT string_split(dir, '/')[1] AS dir, CASE WHEN page_id % 2 = 0 THEN 'maven' ELSE 'npm' END AS build FROM files WHERE dir <> ''
    UNION ALL SELECT dir, 'gradle' FROM files WHERE page_id % 5 = 0 AND dir LIKE '%/%'),
b AS (SELECT dir, min(build) AS type FROM built GROUP BY dir),
found AS (SELECT path, arg_max(b.dir, length(b.dir)) AS container, arg_max(type, length(b.dir)) AS type FROM (SELECT DISTINCT path, dir FROM files) f JOIN b ON f.dir = b.dir OR starts_with(f.dir, b.dir || '/') GROUP BY path)
SELECT path, coalesce(container, '') AS container, coalesce(type, 'sources') AS type FROM (SELECT DISTINCT path FROM files) LEFT JOIN found USING (path)""",
    "q64_register": """
WITH l AS (SELECT DISTINCT l_partkey AS p, 's' || l_suppkey AS file, l_orderkey AS line, l_linenumber AS n FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY file, line, n) AS k, row_number() OVER (PARTITION BY p ORDER BY n % 3, file, line, n) AS told FROM l)
SELECT 'p' || p AS symbolId, max(file) FILTER (k = 1) AS filePath, max(line) FILTER (k = 1) AS line, max(file || ' says') FILTER (told = 1 AND n % 3 = 0) AS docstring, string_agg(DISTINCT 'm' || n, ',' ORDER BY 'm' || n) AS modifiers FROM r GROUP BY p""",
    "q65_stereotypes": """
SELECT DISTINCT 'c' || c_custkey AS symbolId, role FROM (
    SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'service' WHEN 'MACHINERY' THEN 'entity' END AS role FROM customer
    UNION ALL SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'entity' ELSE 'route' END FROM customer) WHERE role IS NOT NULL""",
    "q67_token_reduction": f"""
WITH t AS (SELECT doc_id, sum({_EST.format("regexp_extract(text, '^([^.!?]*[.!?])', 1)")})::BIGINT AS p, sum({_EST.format('text')})::BIGINT AS s FROM documents GROUP BY doc_id)
SELECT doc_id, p AS prompt_tokens, s AS source_tokens, CASE WHEN s > 0 THEN round(100 - 100 * p / s, 1) END AS percent_less FROM t""",
    "q68_annotation_text": """
SELECT event_id, '@' || event_type || CASE user_id % 3 WHEN 0 THEN '(' || (props->>'$.k') || ')' WHEN 1 THEN '(k = ' || (props->>'$.k') || ', of = ' || user_id || ')' ELSE '' END AS shown,
    CASE WHEN event_type = 'click' AND user_id % 3 = 0 THEN props->>'$.k' END AS value FROM events""",
    "q69_symbol_ids": """
WITH t AS (SELECT *, list_slice(['List', 'B' || p_size, 'int...'], 1, p_size % 4) AS kinds FROM part)
SELECT p_partkey, p_brand || '.' || p_name || CASE WHEN p_size % 5 = 0 THEN '' ELSE '(' || array_to_string(kinds, ',') || ')' END AS id,
    CASE WHEN p_size % 5 <> 0 THEN p_name || '(' || array_to_string(list_transform(kinds, lambda t, i: t || ' p' || (i - 1)), ', ') || ')' END AS signature FROM t""",
    "q70_prompts_above": f"""
WITH RECURSIVE lines AS (SELECT n_name, row_number() OVER (PARTITION BY n_name ORDER BY c_name, 'c' || c_custkey) AS line_no, '  - ' || c_name || ': ' || c_mktsegment || ' ' || r_name || chr(10) AS line FROM {_CUSTOMERS}),
sized AS (SELECT *, {_EST.format('line')} AS n FROM lines),
walk(n_name, line_no, chunk, used) AS (
    SELECT n_name, line_no, 0::BIGINT, n::BIGINT FROM sized WHERE line_no = 1
    UNION ALL SELECT s.n_name, s.line_no, CASE WHEN used + n > {_ROOM} THEN chunk + 1 ELSE chunk END, CASE WHEN used + n > {_ROOM} THEN n ELSE used + n END
    FROM walk w JOIN sized s ON s.n_name = w.n_name AND s.line_no = w.line_no + 1),
p AS (
    SELECT n_name AS node_id, chunk, 'SYSTEM' || chr(10) || '{tiers.SYSTEM}' || chr(10) || chr(10) || 'CONTEXT' || chr(10) || 'Container: ' || n_name || chr(10) || chr(10) || 'STRUCTURE' || chr(10) ||
        string_agg(line, '' ORDER BY line_no) || chr(10) || chr(10) || 'TASK' || chr(10) || '{tiers.TASK}' AS prompt
    FROM walk JOIN sized USING (n_name, line_no) GROUP BY n_name, chunk)
SELECT node_id, chunk, prompt, {_EST.format('prompt')} AS tokens FROM p""",
}
_SLUG = "lower(regexp_replace({0}, '[^A-Za-z0-9._]+', '-', 'g')) || '[\"' || {0} || '\"]'"
ORACLE_SQL["q66_diagram"] = f"""
WITH m AS ({ORACLE_SQL["q39_tier_lift"]}), l AS (SELECT '  ' || {_SLUG.format("src_tier")} || ' --> ' || {_SLUG.format("dst_tier")} AS line FROM m)
SELECT 'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS diagram FROM l"""
