"""The static site: pages as rows of a DataFrame, then as files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators import mentions, search
from codestrata.operators.index import TYPE_KINDS
from codestrata.session import cut
from codestrata.sources.files import read_lines
from codestrata.sources.pages import write_pages

CSS = "body{font:16px/1.5 sans-serif;margin:0;display:flex}nav{width:18rem;padding:1rem;position:sticky;top:0;height:100vh;overflow:auto}main{padding:1rem 2rem;max-width:60rem}pre{background:#f4f4f4;padding:.5rem;overflow:auto}pre i{font-style:normal}pre .k{color:#70c;font-weight:bold}pre .s{color:#272}pre .c{color:#777}iframe{border:0;width:100%;height:60vh}@media(prefers-color-scheme:dark){body{background:#181818;color:#ddd}pre{background:#222}a{color:#8bf}pre .k{color:#c9f}pre .s{color:#8d8}}"
def _page(title, crumb, body, depth: int):
    """A whole page from expressions of its title, breadcrumb and body."""
    up = "../" * depth
    nav = "".join(f'<li><a href="{up}{p}.html">{name}</a></li>' for p, name in (("index", "Overview"), ("tech", "Technology"), ("tests", "Tests"), ("architecture", "Architecture"), ("modules/index", "Modules")))
    head = f'<link rel="stylesheet" href="{up}assets/style.css"></head><body data-up="{up}"><nav><input id="search" placeholder="Search"><ul id="hits"></ul><ul>{nav}</ul><iframe title="Contents" src="{up}nav/index.html"></iframe></nav><main><p class="crumb">'
    tail = f'</main><script src="{up}assets/search.js"></script></body></html>\n'
    return F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), T.html_escape(title), F.lit("</title>"), F.lit(head), T.html_escape(crumb), F.lit("</p><h1>"), T.html_escape(title), F.lit("</h1>"), body, F.lit(tail))


def _items(rows: DataFrame, key, item, order) -> DataFrame:
    """``key`` and its items as an ordered HTML list."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("x")))), lambda r: F.concat(F.lit("<li>"), r["x"], F.lit("</li>")))
    return rows.groupBy(key.alias("key")).agg(F.concat(F.lit("<ul>"), F.array_join(lines, "\n"), F.lit("</ul>")).alias("items"))


def _file(fqn):
    """A type's or module's page; names that differ in case or signs alone would meet, so that a short digest of the name is added."""
    return F.concat(T.slug(fqn), F.lit("-"), F.substring(F.md5(fqn), 1, 6), F.lit(".html"))


def _link(fqn, depth: int):
    return F.concat(F.lit(f'<a href="{"../" * depth}symbols/'), _file(fqn), F.lit('">'), T.html_escape(fqn), F.lit("</a>"))


def link_mentions(rows: DataFrame, key: str, column: str, known: DataFrame, depth: int) -> DataFrame:
    """``rows`` with ``column`` as HTML, in which known names lead to pages.

    ``known`` has the ``target`` of each page, and maybe the ``name`` that means it, else the target itself; names with several
    targets lead nowhere. The longest name at a place wins, see ``mentions``. A target may have an anchor after ``#``.
    """
    names = known.select((F.col("name") if "name" in known.columns else F.col("target")).alias("name"), "target")
    found = mentions.find_names(rows, key, column, names)
    page = lambda x: F.element_at(F.split(x, "#", 2), 1)
    anchor = lambda x: F.regexp_extract(x, "(?s)^[^#]*(#.*)?$", 1)
    link = lambda p: F.concat(F.lit(f'<a href="{"../" * depth}symbols/'), _file(page(p["target"])), T.html_escape(anchor(p["target"])), F.lit('">'), T.html_escape(p["text"]), F.lit("</a>"))
    html = F.transform("pieces", lambda p: F.when(p["target"].isNotNull(), link(p)).otherwise(T.html_escape(p["text"])))
    return found.withColumn(column, F.when(F.col("pieces").isNotNull(), F.array_join(html, ""))).drop("pieces")


#: A simple name that is hardly a word of prose: it has a capital letter inside.
INNER_CAPITAL = r"^.*[a-z0-9]\.?[A-Z].*$"


def known_names(placed: DataFrame, prose: bool = True) -> DataFrame:
    """``name`` and ``target`` of all that has a place on a page: types by full, nested and simple names, methods by their signatures.

    In prose simple names count only if they look like names.
    """
    types = placed.where(F.col("kind").isin(*TYPE_KINDS)).select("symbolId", "name", F.element_at(F.split("parentSymbolId", r"\."), -1).alias("outer"))
    simple = types.where(F.col("name").rlike(INNER_CAPITAL)) if prose else types
    methods = placed.where((F.col("kind") == "METHOD") & F.col("class_id").isNotNull())
    anchor = F.concat("class_id", F.lit("#"), "symbolId").alias("target")
    parts = [
        types.select(F.col("symbolId").alias("name"), F.col("symbolId").alias("target")),
        simple.select("name", F.col("symbolId").alias("target")),
        types.where("outer IS NOT NULL").select(F.concat_ws(".", "outer", "name").alias("name"), F.col("symbolId").alias("target")),
        methods.select(F.col("symbolId").alias("name"), anchor),
        methods.select(F.concat(F.element_at(F.split("class_id", r"\."), -1), F.lit("."), T.short_signature(F.col("name"), F.col("signature.parameters"))).alias("name"), anchor),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def tree_pages(placed: DataFrame) -> DataFrame:
    """The sidebar's tree, which all pages show in a frame: modules, and for each one its containers, components and types."""
    types = placed.where(F.col("kind").isin(*TYPE_KINDS))
    fold = lambda c, items: F.concat(F.lit("<details open><summary>"), T.html_escape(F.col(c)), F.lit("</summary>"), F.col(items), F.lit("</details>"))
    leaf = F.concat(F.lit('<a href="../symbols/'), _file(F.col("symbolId")), F.lit('">'), T.html_escape(F.col("name")), F.lit("</a>"))
    components = _items(types, F.struct("module", "container", "component"), leaf, F.struct("name", "symbolId")).select("key.*", "items")
    containers = _items(components, F.struct("module", "container"), fold("component", "items"), F.col("component")).select("key.*", "items")
    modules = _items(containers, F.col("module"), fold("container", "items"), F.col("container"))
    file = F.concat(T.slug(F.col("key")), F.lit("-"), F.substring(F.md5("key"), 1, 6), F.lit(".html"))
    page = lambda body: F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><base target="_top"><link rel="stylesheet" href="../assets/style.css"></head><body><div>'), body, F.lit("</div></body></html>\n"))
    back = F.concat(F.lit('<p><a target="_self" href="index.html">All modules</a></p><h3>'), T.html_escape(F.col("key")), F.lit("</h3>"), F.col("items"))
    each = modules.select(F.concat(F.lit("nav/"), file).alias("rel_path"), F.lit(None).cast("string").alias("title"), page(back).alias("html"))
    link = F.concat(F.lit('<a target="_self" href="'), file, F.lit('">'), T.html_escape(F.col("key")), F.lit("</a>"))
    there = placed.sparkSession.createDataFrame([("all",)], "key string")
    every = there.join(_items(modules, F.lit("all"), link, F.col("key")), "key", "left")
    return each.unionByName(every.select(F.lit("nav/index.html").alias("rel_path"), F.lit(None).cast("string").alias("title"), page(F.coalesce("items", F.lit("<p>None found.</p>"))).alias("html")))


def symbol_pages(placed: DataFrame, edges: DataFrame, summarised: DataFrame, sources: DataFrame) -> DataFrame:
    """A page for each type: its summary, members, links both ways, and its code, all resolved by joins."""
    types = placed.where(F.col("kind").isin(*TYPE_KINDS))
    known = types.select(F.col("symbolId").alias("target")).distinct()
    owner = placed.select(F.col("symbolId").alias("symbol"), F.col("class_id").alias("class"))
    by_class = edges.where("kind <> 'CONTAINS'").join(owner.withColumnsRenamed({"symbol": "src", "class": "from"}), "src").join(owner.withColumnsRenamed({"symbol": "dst", "class": "to"}), "dst", "left")
    links = by_class.select("from", F.coalesce("to", "dst").alias("to"), "kind").where("`from` <> `to`").distinct()
    shown = links.join(known, F.col("to") == F.col("target"), "left").withColumn("item", F.concat("kind", F.lit(" "), F.when(F.col("target").isNotNull(), _link(F.col("to"), 1)).otherwise(T.html_escape(F.col("to")))))
    out = _items(shown, F.col("from"), F.col("item"), F.struct("kind", "to")).withColumnsRenamed({"key": "symbolId", "items": "uses"})
    back = links.join(known, F.col("to") == F.col("target")).withColumn("item", F.concat("kind", F.lit(" "), _link(F.col("from"), 1)))
    into = _items(back, F.col("to"), F.col("item"), F.struct("kind", "from")).withColumnsRenamed({"key": "symbolId", "items": "used_by"})
    names, written = cut(known_names(placed)), cut(known_names(placed, prose=False))
    shown = F.coalesce(T.short_signature(F.col("name"), F.col("signature.parameters"), True), F.concat_ws(" ", "signature.returnType", "name"))
    members = placed.where(F.col("kind").isin("METHOD", "FIELD", "PROPERTY")).select("symbolId", "class_id", "range", "docstring", shown.alias("shown"), F.array_join(F.transform("annotations", T.annotation_text), " ").alias("marks"))
    member = link_mentions(link_mentions(members, "symbolId", "docstring", names, 1), "symbolId", "shown", written, 1)
    text = F.concat(F.lit('<code id="'), T.html_escape(F.col("symbolId")), F.lit('">'), T.html_escape(F.concat("marks", F.when(F.col("marks") != "", " ").otherwise(""))), F.col("shown"), F.lit("</code> "), F.coalesce("docstring", F.lit("")), F.concat(F.lit(" <small>lines "), F.col("range.startLine").cast("string"), F.lit("–"), F.col("range.endLine").cast("string"), F.lit("</small>")))
    members = _items(member, F.col("class_id"), text, F.struct("range.startLine", "symbolId")).withColumnsRenamed({"key": "symbolId", "items": "members"})
    told = link_mentions(summarised.where("tier = 5").select(F.col("node_id").alias("symbolId"), "summary"), "symbolId", "summary", names, 1)
    wanted = types.select("symbolId", F.col("filePath").alias("path"), F.col("range.startLine").alias("start_line"), F.col("range.endLine").alias("end_line"))
    code = read_lines(sources, wanted).select("symbolId", F.concat(F.lit("<pre><code>"), T.highlight(F.col("body")), F.lit("</code></pre>")).alias("code"))
    joined = types.join(out, "symbolId", "left").join(into, "symbolId", "left").join(members, "symbolId", "left").join(told, "symbolId", "left").join(code, "symbolId", "left")
    sections = {"Members": "members", "Uses": "uses", "Used by": "used_by", "Code": "code"}
    part = lambda title, c: F.coalesce(F.concat(F.lit(f'<h2 id="{c}">{title}</h2>'), F.col(c)), F.lit(""))
    contents = F.concat(F.lit('<ul class="contents">'), *(F.when(F.col(c).isNotNull(), F.lit(f'<li><a href="#{c}">{title}</a></li>')).otherwise("") for title, c in sections.items()), F.lit("</ul>"))
    facts = F.concat(F.lit("<details><summary>Facts</summary><pre>"), T.html_escape(F.concat_ws("\n", F.lower("kind"), F.concat_ws(" ", "modifiers"), "filePath", F.concat_ws(", ", F.transform("annotations", T.annotation_text)))), F.lit("</pre></details>"))
    body = F.concat(F.lit("<p>"), F.coalesce("summary", F.lit("")), F.lit("</p>"), contents, facts, *(part(title, c) for title, c in sections.items()))
    crumb = T.breadcrumb(F.col("module"), F.col("container"), F.col("component"), F.col("name"))
    return joined.select(F.concat(F.lit("symbols/"), _file(F.col("symbolId"))).alias("rel_path"), F.col("symbolId").alias("title"), _page(F.col("symbolId"), crumb, body, 1).alias("html"))


def module_pages(placed: DataFrame, summarised: DataFrame) -> DataFrame:
    types = placed.where(F.col("kind").isin(*TYPE_KINDS))
    listed = _items(types, F.col("module"), F.concat(T.html_escape(T.breadcrumb(F.col("container"), F.col("component"))), F.lit(": "), _link(F.col("symbolId"), 1)), F.struct("container", "component", "symbolId"))
    known = known_names(placed)
    told = link_mentions(summarised.where("tier = 2").select(F.col("node_id").alias("key"), "summary"), "key", "summary", known, 1)
    rows = listed.join(told, "key", "left")
    body = F.concat(F.lit("<p>"), F.coalesce("summary", F.lit("")), F.lit("</p>"), F.col("items"))
    pages = rows.select(F.concat(F.lit("modules/"), _file(F.col("key"))).alias("rel_path"), F.col("key").alias("title"), _page(F.col("key"), F.col("key"), body, 1).alias("html"))
    every = _items(rows, F.lit("Modules"), F.concat(F.lit('<a href="'), _file(F.col("key")), F.lit('">'), T.html_escape(F.col("key")), F.lit("</a>")), F.col("key"))
    return pages.unionByName(every.select(F.lit("modules/index.html").alias("rel_path"), F.lit("Modules").alias("title"), _page(F.lit("Modules"), F.lit("Modules"), F.col("items"), 1).alias("html")))


def view_page(name: str, title: str, rows: DataFrame, item, order) -> DataFrame:
    """One of the top-level views: a list of what ``rows`` holds; there is a page even without rows."""
    there = rows.sparkSession.createDataFrame([(title,)], "key string")
    listed = there.join(_items(rows, F.lit(title), item, order), "key", "left")
    return listed.select(F.lit(f"{name}.html").alias("rel_path"), F.lit(title).alias("title"), _page(F.lit(title), F.lit(title), F.coalesce("items", F.lit("<p>None found.</p>")), 0).alias("html"))


def title_index(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The numbers of the pages that have a title, and the blocks of the terms of titles."""
    titled = pages.where("title IS NOT NULL").select("rel_path", "title")
    numbers = cut(search.numbered(titled, "rel_path"))
    return numbers, cut(search.blocks(search.postings(titled.join(numbers, "rel_path"), search.terms_of(F.col("title")))))


def search_terms(pages: DataFrame) -> DataFrame:
    """``term``, on how many pages it is, and the first of these."""
    numbers, found = title_index(pages)
    each = found.groupBy("term").agg(F.sum("n").alias("n_pages"), F.min("first").alias("number"))
    return each.join(numbers, "number").select("term", "n_pages", F.col("rel_path").alias("first_page"))


def site_files(pages: DataFrame) -> DataFrame:
    """``rel_path`` and ``html`` of all files of the site: pages, style, script, and the tree of the search index."""
    numbers, found = title_index(pages)
    assets = [("assets/style.css", CSS), ("assets/search.js", search.SEARCH + search.BOX)]
    parts = [pages.select("rel_path", "html"), pages.sparkSession.createDataFrame(assets, "rel_path string, html string"), search.tree_files(found), search.name_files(numbers, "rel_path")]
    return reduce(DataFrame.unionByName, parts)


def write_site(pages: DataFrame, out: str) -> None:
    """Replaces ``out`` by the site, as a whole or not at all; see ``sources.pages`` for what storage it may be on."""
    write_pages(site_files(pages), out)
