"""The whole analysis of a small repository in two languages."""

import json
import re
from pathlib import Path

import pytest

from codestrata import cli
from codestrata.functions import text as T
from codestrata.operators import graph, index, parsing, tiers
from codestrata.operators import relational as R
from codestrata.sources import files as S

SHOP = str(Path(__file__).parent / "fixtures/shop")


@pytest.fixture(scope="module")
def out(tmp_path_factory):
    return tmp_path_factory.mktemp("out")


@pytest.fixture(scope="module")
def run(spark, out):
    return cli.analyze(spark, SHOP, str(out / "a"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_inventory(spark):
    files = S.scan_structure(spark, SHOP)
    assert rows(files.where("language IS NOT NULL").groupBy("language").count(), "language", "count") == [("csharp", 2), ("java", 5)]
    assert ("billing", "", 1, 6) in rows(S.directories(files), "dir", "parent_dir", "depth", "n_files")
    assert rows(S.manifests(files), "dir", "build") == [("billing", "maven"), ("store/Api", "dotnet")]
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in re.search(r"ReadSchema: (\S+)", plan)[1]


def test_size_limit_and_line_ranges(spark):
    assert S.read_sources(spark, SHOP, max_bytes=200).count() < S.read_sources(spark, SHOP).count() == 7
    wanted = spark.createDataFrame([("store/Api/Api.csproj", 1, 1), ("store/Api/OrderController.cs", 5, 5)], "path string, start_line int, end_line int")
    assert rows(S.read_lines(S.read_sources(spark, SHOP), wanted), "body") == [("namespace Demo.Store;",)]


def test_symbols(run):
    found = {r.symbolId: r for r in run.symbols.collect()}
    java = {i for i, r in found.items() if r.language == "java" and "Broken" not in i}
    base = "org.demo.billing."
    assert java == {
        base + x for x in (
            "Invoice", "Invoice.MARK", "Invoice.items", "Invoice.a", "Invoice.b", "Invoice.total(Taxes,int...)", "Invoice.round(int)", "Invoice.round(int,int)", "Invoice.State", "Invoice.State.code",
            "Invoice.Item", "Invoice.Item.price()", "Invoice.Cached", "Invoice.Cached.seconds()", "Invoice.Cached.name()", "Paper", "Paper.total(Taxes,int...)", "Payable", "Payable.total(Taxes,int...)",
            "Ledger", "Ledger.<init>(long)", "Ledger.gone", "tax.Taxes", "tax.Taxes.text", "tax.Taxes.brace", "InvoiceTest", "InvoiceTest.addsUp()", "InvoiceTest.empty()",
        )
    }
    total = found[base + "Invoice.total(Taxes,int...)"]
    assert total.docstring == "Adds up all items." and total.throws == ["IllegalStateException", "BadTax"]
    assert [(a.name, a.args) for a in total.annotations] == [("Override", {}), ("Cached", {"seconds": "5", "name": "total"})]
    assert (total.range.startLine, total.range.endLine) == (17, 24) and total.signature.returnType == "long"
    invoice = found[base + "Invoice"]
    assert (invoice.extends, invoice.implements, invoice.modifiers) == (["Paper"], ["Payable", "Comparable<Invoice>"], ["public"])
    cs = found["Demo.Store.OrderController.Get(int,string,object[])"]
    assert cs.isAsync and [(p.name, p.mode) for p in cs.signature.parameters] == [("id", "ref"), ("q", None), ("rest", "params")]
    assert found["Demo.Store.OrderController.Name"].accessors == ["get", "set"]
    assert found["Demo.Store.OrderController"].docstring == "Takes orders."
    assert found["Demo.Store.OrderController"].extends == ["ControllerBase"]
    assert "Demo.Store.OrderController.Ping()" in found and "Demo.Store.Mode" in found
    assert rows(run.errors, "path", "error") == [("billing/src/main/java/org/demo/billing/Broken.java", "unbalanced braces")]


def test_edges(run):
    found = set(rows(run.edges, "kind", "src", "dst", "resolved"))
    base = "org.demo.billing."
    total = base + "Invoice.total(Taxes,int...)"
    assert {
        ("EXTENDS", base + "Invoice", base + "Paper", True), ("IMPLEMENTS", base + "Paper", base + "Payable", True), ("IMPLEMENTS", base + "Invoice", "Comparable", False),
        ("DEPENDS_ON", total, base + "tax.Taxes", True), ("DEPENDS_ON", total, base + "Ledger", True), ("DEPENDS_ON", total, "BadTax", False),
        ("COMPOSES", base + "Invoice", base + "Invoice.Item", True), ("COMPOSES", base + "Ledger", "Missing", False), ("COMPOSES", "Demo.Store.OrderController", "Demo.Store.IStock", True),
        ("CALLS", total, base + "Invoice.round(int)", True), ("CALLS", total, base + "Invoice.Item.price()", True), ("CALLS", "Demo.Store.OrderController.Get(int,string,object[])", "Demo.Store.OrderController.Find(int)", True),
        ("OVERRIDES", total, base + "Paper.total(Taxes,int...)", True), ("OVERRIDES", total, base + "Payable.total(Taxes,int...)", True),
        ("IMPORTS", "billing/src/main/java/org/demo/billing/Invoice.java", base + "tax", True), ("CONTAINS", base + "Invoice", base + "Invoice.State", True),
    } <= found
    assert not any(k == "CALLS" and d == base + "Invoice.round(int,int)" for k, _, d, _ in found)


def test_tiers_and_graph(spark, run, out):
    assert rows(run.symbols.select("module", "container", "container_type").distinct(), "module", "container", "container_type") == [("billing", "billing", "maven"), ("store", "store/Api", "dotnet")]
    assert graph.validate(run.nodes, run.edges).count() == 0
    nodes, edges = S.load_graph(spark, str(out / "a/graph.json"))
    assert nodes.count() == run.nodes.count() and edges.count() == run.edges.count()
    assert ("org.demo.billing.Paper", "billing/src/main/java/org/demo/billing/Paper.java") in rows(graph.dependencies(nodes, edges, "org.demo.billing.Invoice"), "dst", "path")
    assert "org.demo.billing.InvoiceTest.addsUp()" in {r.src for r in graph.dependents(nodes, edges, "org.demo.billing.Invoice").collect()}
    assert ("org.demo.billing.Payable", 1) in rows(graph.reachable(edges, "org.demo.billing.Invoice", 3), "node", "depth")
    assert {r.id for r in graph.retrieve(nodes, ["billing"]).collect()} >= {"billing", "billing|billing"}
    for terms, k in ((["billing"], 2), (["types", "Demo", "components"], 3), (["nothing"], 5)):
        assert rows(graph.retrieve(nodes, terms, k, graph.node_index(nodes)), "id", "score") == rows(graph.retrieve(nodes, terms, k), "id", "score")
    bad = nodes.unionByName(nodes.where("tier = 1")).unionByName(spark.createDataFrame([("x", "CLASS", "x", 5, "y", None, None, None, None)], nodes.schema))
    assert {"repeated id", "missing parent", "no root above"} >= {r.problem for r in graph.validate(bad, edges).collect()} >= {"repeated id", "missing parent"}
    overview = S.load_overview(spark, str(out / "a/indexes/structure_overview.json"))
    assert ("Demo.Store.OrderController", "Get(int,string,object[])") in rows(overview, "class", "method")


def test_prompts_stay_under_the_budget(run):
    sizes = [r.tokens for r in run.prompts.collect()]
    assert sizes and max(sizes) < 2000
    small = tiers.chunks(run.symbols, 60)
    assert max(r.tokens for r in small.collect()) <= 60
    whole = {r.line for r in tiers.skeletons(run.symbols).collect()}
    cut = "".join(r.skeleton for r in small.orderBy("node_id", "chunk").collect()).splitlines()
    assert len(cut) == tiers.skeletons(run.symbols).count() and {c for c in cut if len(c) < 200} <= whole


def test_model_modes(spark, out):
    def model(prompt):
        if "Demo.Store" in prompt:
            raise TimeoutError
        return "word " * 200

    told = cli.analyze(spark, SHOP, str(out / "b"), model=model).summaries
    texts = {r.node_id: r.summary for r in told.where("tier = 4").collect()}
    assert texts["billing|billing|org.demo.billing"].split() == ["word"] * 99
    assert "types" in texts["store|store/Api|Demo.Store"]
    assert cli.ModelConfig().model() is None and callable(cli.ModelConfig("local").model())


def test_what_is_told_of_a_tier_goes_into_the_prompts_above(spark, run):
    told = spark.createDataFrame([(4, "m|c|p", "m|c", "p", "  Takes\n orders."), (4, "m|c|q", "m|c", "q", None), (3, "m|c", "m", "c", "x")], "tier int, node_id string, parent_id string, name string, summary string")
    found = tiers.prompts_above(told, 3).collect()
    assert [(r.tier, r.node_id, r.chunk) for r in found] == [(3, "m|c", 0)]
    assert "STRUCTURE\n  - p: Takes orders.\n  - q: \n" in found[0].prompt and "CONTEXT\nContainer: m|c\n" in found[0].prompt
    many = spark.createDataFrame([(4, f"m|c|k{i}", "m|c", f"k{i}", "word " * 300) for i in range(40)], told.schema)
    sizes = [r.tokens for r in tiers.prompts_above(many, 3).collect()]
    assert len(sizes) > 1 and max(sizes) < 2000


def test_a_model_is_asked_from_components_to_the_repository(spark, out):
    def model(prompt):
        return "top" if "Repository: shop" in prompt else "middle" if "Module: billing\n" in prompt else "low"

    def seen(prompt):
        return "saw middle" if "Repository: shop" in prompt and "billing: middle" in prompt else model(prompt)

    told = {(r.tier, r.node_id): r.summary for r in cli.analyze(spark, SHOP, str(out / "c"), model=seen).summaries.collect()}
    assert told[1, "shop"] == "saw middle" and told[2, "billing"] == "middle" and told[3, "billing|billing"] == "low"
    few = cli.analyze(spark, SHOP, str(out / "c"), cli.ModelConfig(most_calls=1), model=seen).summaries
    assert few.where("summary IN ('low', 'middle', 'saw middle')").count() == 1


def test_templates(spark, out, run):
    one = spark.range(1).select(T.fill("a {{x}} {{ y }}{{x}}", x=spark_lit("1"), y=spark_lit(None)).alias("t")).first()
    assert one.t == "a 1 1"
    with pytest.raises(KeyError):
        T.fill("{{nothing}}")
    prompts = tiers.prompts(run.symbols, template="{{task}} // {{structure}}").collect()
    assert prompts and all(r.prompt.startswith(tiers.TASK + " // ") for r in prompts)


def spark_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value).cast("string")


def test_limit_of_lines(spark):
    assert S.read_sources(spark, SHOP, max_lines=10).count() < 7


def test_files_left_out_are_told(spark):
    assert S.left_out(spark, SHOP).count() == 0
    sizes = {r.path: r.n_bytes for r in S.scan_structure(spark, SHOP).where("language IS NOT NULL").collect()}
    assert rows(S.left_out(spark, SHOP, max_bytes=200), "path") == sorted((p,) for p, n in sizes.items() if n > 200)
    read = {r.path for r in S.read_sources(spark, SHOP, 900, 10).collect()}
    assert {p for p, in rows(S.left_out(spark, SHOP, 900, 10), "path")} == {*sizes} - read


def test_ratio_of_tokens(spark, run):
    one = tiers.reduction(spark.createDataFrame([(30,), (20,)], "tokens long"), spark.createDataFrame([("x" * 800,)], "text string")).first()
    assert tuple(one) == (50, 200, 75.0)
    assert tiers.reduction(run.prompts.limit(0), spark.createDataFrame([], "text string")).first().percent_less is None


def test_annotations_with_arguments(run):
    found = run.symbols.where("name = 'total' AND size(annotations) = 2").select(T.annotation_text(spark_col("annotations")[1]).alias("x"), T.annotation_text(spark_col("annotations")[0]).alias("y")).first()
    assert tuple(found) == ("@Cached(name = total, seconds = 5)", "@Override")


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_lines_are_read_by_seeking(spark, tmp_path, end):
    from codestrata.sources import lines

    texts = {"a/Long.java": [f"line {i} é" for i in range(3000)], "b.cs": ["﻿first", "", "third"], "Empty.java": [""], "One.java": ["x" * 200_000, "y"]}
    for path, rows_ in texts.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(end.join(rows_).encode())
    asked = [("a/Long.java", a, b) for a, b in ((1, 1), (1, 3000), (255, 258), (257, 257), (2999, 3005), (3001, 3002), (512, 511), (5000, 5001))] + [("b.cs", 1, 3), ("b.cs", 2, 2), ("Empty.java", 1, 1), ("One.java", 2, 2), ("gone.java", 1, 1)]
    wanted = spark.createDataFrame(asked, "path string, start_line int, end_line int")
    offsets = lines.line_offsets(spark, str(tmp_path), 10**9)
    found = {(r.path, r.start_line, r.end_line): r for r in lines.read_ranges(wanted, offsets, str(tmp_path)).collect()}
    expected = {(r.path, r.start_line, r.end_line): r.body for r in S.read_lines(S.read_sources(spark, str(tmp_path)), wanted.where("start_line <= end_line")).collect()}
    assert {k: r.body for k, r in found.items() if k[1] <= k[2]} == expected and found["a/Long.java", 512, 511].body == ""
    assert found["a/Long.java", 2999, 3005].bytes_read < 7000 and found["a/Long.java", 257, 257].bytes_read <= lines.CHUNK


def test_calls_with_several_candidates_stay_one_edge(spark):
    kind = "kind string, symbolId string, parentSymbolId string, name string, signature struct<parameters:array<struct<type:string,name:string>>>, calls array<struct<name:string,n_args:int>>"
    rows_ = [("METHOD", f"T{i}.get()", f"T{i}", "get", ([],), []) for i in range(30)] + [("METHOD", "T1.only()", "T1", "only", ([],), [])]
    rows_ += [("METHOD", f"U{i}.run()", f"U{i}", "run", ([],), [("get", 0), ("only", 0), ("gone", 0)]) for i in range(20)]
    found = index.call_edges(spark.createDataFrame(rows_, kind)).collect()
    assert sorted((r.src, r.dst, r.resolved) for r in found) == sorted(x for i in range(20) for x in ((f"U{i}.run()", "get/0", False), (f"U{i}.run()", "T1.only()", True)))


def test_calls_of_symbols_with_one_row_are_not_shuffled_as_edges(spark):
    kind = "kind string, symbolId string, parentSymbolId string, name string, signature struct<parameters:array<struct<type:string,name:string>>>, calls array<struct<name:string,n_args:int>>"
    rows_ = [("METHOD", f"T.get{i}()", "T", "get", ([],), []) for i in range(5)] + [("METHOD", f"T.run{i}()", "T", "run", ([],), [("get", 0), ("get", 0)]) for i in range(4)]
    pairs = sorted((f"T.run{i}()", f"T.get{j}()", True) for i in range(4) for j in range(5))
    found = index.call_edges(spark.createDataFrame(rows_, kind))
    assert sorted((r.src, r.dst, r.resolved) for r in found.collect()) == pairs
    assert "hashpartitioning(src" not in found._jdf.queryExecution().executedPlan().toString()
    twice = index.call_edges(spark.createDataFrame(rows_ + rows_[-2:] + rows_[:1], kind)).collect()
    assert sorted((r.src, r.dst, r.resolved) for r in twice) == pairs


def test_calls_meet_methods_of_one_name_in_lists(spark, monkeypatch):
    monkeypatch.setattr(index, "LIST", 4)
    kind = "kind string, symbolId string, parentSymbolId string, name string, signature struct<parameters:array<struct<type:string,name:string>>>, calls array<struct<name:string,n_args:int>>"
    many = {"four": 4, "five": 5, "twenty": 20, "one": 1}
    rows_ = [("METHOD", f"T.{m}{i}", "T", m, ([],), []) for m, n in many.items() for i in range(n)] + [("METHOD", None, "T", "five", ([],), []), ("METHOD", "X.far", "X", "far", ([],), [])]
    rows_ += [("METHOD", f"T.run{i}", "T", "run", ([],), [(m, 0) for m in [*many, "far", "gone"]]) for i in range(6)] + [("METHOD", "lone", None, "run", ([],), [("one", 0)])]
    expected = [(f"T.run{i}", f"T.{m}{j}", True) for i in range(6) for m, n in many.items() for j in range(n)] + [(f"T.run{i}", x, True) for i in range(6) for x in (None, "X.far")]
    found = index.call_edges(spark.createDataFrame(rows_, kind))
    assert sorted(map(repr, map(tuple, found.drop("kind").collect()))) == sorted(map(repr, expected))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(dst" in plan[: plan.index("SortMergeJoin [owner")]  # edges are first made after the last join
    assert found.rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism  # not one, as their bytes would have it
    twice = index.call_edges(spark.createDataFrame(rows_ + rows_[:7] + rows_[-3:], kind))
    assert sorted(map(repr, map(tuple, twice.drop("kind").collect()))) == sorted(map(repr, expected))


def test_command_line(spark, out, capsys):
    assert cli.main(["analyze", str(out / "nowhere")]) == 2
    assert "not a directory" in capsys.readouterr().err
    assert cli.main(["query", str(out / "a/graph.json"), "org.demo.billing.Invoice", "--kind", "EXTENDS"]) == 0
    assert capsys.readouterr().out.split() == ["org.demo.billing.Invoice", "EXTENDS", "org.demo.billing.Paper"]


def test_search_command(spark, run, out, capsys):
    assert cli.main(["search", str(out / "a"), "billing", "--most", "1"]) == 0
    assert capsys.readouterr().out.splitlines()[:2] == ["1 REPOSITORY shop 1", "2 MODULE billing 1"]


def test_modules_that_differ_in_case_have_pages_of_their_own(spark, run):
    from pyspark.sql import functions as F

    from codestrata.operators import site

    both = run.symbols.withColumn("module", F.explode(F.array(*map(F.lit, ("Core", "core", "a b", "a-b")))))
    paths = [r.rel_path for r in site.module_pages(both, run.summaries).collect()]
    assert len(paths) == len(set(paths)) == 5


def test_tests_and_roles(run):
    assert rows(index.tests(run.symbols), "name") == [("addsUp",), ("empty",)]
    assert ("Demo.Store.OrderController", "controller") in rows(index.stereotypes(run.symbols), "symbolId", "role")
    assert ("COMPOSES", "Missing", 1) in rows(index.unresolved_report(run.edges), "kind", "dst", "n")


def test_hostile_sources():
    assert [r["kind"] for r in parsing.parse_file("a", "java", "")] == []
    for text in ("}}}", "class", "class X { int", "@", "class X { @A(", "namespace", "[[[", "((((", "import", "﻿class X {}", "class X<T { }"):
        for language in ("java", "csharp"):
            parsing.parse_file("a", language, text)


def test_pack_units_keeps_the_budget(spark):
    sizes = [40, 400, 8, 8, 8, 2000, 4, 100, 100]
    units = spark.createDataFrame([("a", i, "x" * n) for i, n in enumerate(sizes)] + [("b", 0, "y")], "key string, at int, text string")
    assert rows(R.pack_units(units, "key", "at", "text", 50), "key", "chunk", "n_units", "tokens") == [("a", 0, 1, 10), ("a", 1, 1, 100), ("a", 2, 3, 6), ("a", 3, 1, 500), ("a", 4, 2, 26), ("a", 5, 1, 25), ("b", 0, 1, 1)]


def test_scalar_functions(spark):
    from pyspark.sql import functions as F

    one = spark.range(1).select(
        T.simple_type(F.lit("java.util.List<String>")).alias("a"), T.package_of(F.lit("x.y.Z")).alias("b"), T.slug(F.lit("A b/C")).alias("c"), T.html_escape(F.lit('a<b>&"')).alias("d"),
        T.breadcrumb(F.lit("a"), F.lit(None).cast("string"), F.lit("c")).alias("e"), T.link_to(F.lit("x.Y"), 2).alias("f"), T.extension(F.lit("a/b.TXT")).alias("g"), T.cap_words(F.lit("a b  c d"), 2).alias("h"),
        T.clean_doc(F.lit("/// <summary>\n/// Does it.\n/// </summary>")).alias("i"),
    ).first()
    assert tuple(one) == ("List", "x.y", "a-b-c", "a&lt;b&gt;&amp;&quot;", "a > c", "../../symbols/x.Y.html", "txt", "a b", "Does it.")


def test_graph_document_is_plain_json(out, run):
    document = json.loads((out / "a/graph.json").read_text())
    assert document["schemaVersion"] == graph.VERSION and document["repository"] == "shop"
    assert set(document["nodes"][0]) == {"id", "kind", "name", "tier", "parent", "path", "startLine", "endLine", "summary"}


def test_public_symbols(run):
    from pyspark.sql import functions as F

    kept = {r.symbolId for r in tiers.public(run.symbols).collect()}
    every = {r.symbolId: r.modifiers for r in run.symbols.where("kind NOT IN ('INTERFACE', 'ANNOTATION')").collect()}
    assert {i for i, m in every.items() if "public" in m} <= kept and not {i for i, m in every.items() if "private" in m} & kept
    assert "org.demo.billing.Payable.total(Taxes,int...)" in kept
    none = run.symbols.limit(1).withColumn("modifiers", F.lit(None).cast("array<string>"))
    assert none.select(T.has_modifier(F.col("modifiers"), "public").alias("x")).first().x is False


def test_highlighted_code(spark):
    code = 'class A { // new "x"\n String s = "if \\" <b>"; /* for\n */ int formal; }'
    one = spark.createDataFrame([(code,)], "code string").select(T.highlight(spark_col("code")).alias("x")).first().x
    mark = lambda c, x: f'<i class="{c}">{x}</i>'
    assert one == mark("k", "class") + " A { " + mark("c", "// new &quot;x&quot;") + "\n String s = " + mark("s", "&quot;if \\&quot; &lt;b&gt;&quot;") + "; " + mark("c", "/* for\n */") + " " + mark("k", "int") + " formal; }"


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_mentions_become_links(spark):
    from codestrata.operators import site

    texts = spark.createDataFrame([(1, "See a.B.C, a.B. and a.B.Cx <x>"), (2, "none & a"), (3, None)], "id int, text string")
    known = spark.createDataFrame([("a.B",), ("a.B.C",), ("a",)], "target string")
    found = {r.id: r.text for r in site.link_mentions(texts, "id", "text", known, 1).collect()}
    assert re.sub(r'<a href="../symbols/[^"]+">([^<]+)</a>', r"[\1]", found[1]) == "See [a.B.C], [a.B]. and a.B.Cx &lt;x&gt;"
    assert re.sub(r'<a href="../symbols/[^"]+">([^<]+)</a>', r"[\1]", found[2]) == "none &amp; [a]" and found[3] is None


def test_bodies_on_request(spark, run, out):
    prompts = []

    def model(prompt):
        if "Bodies asked for" in prompt:
            return "told from the body" if "long total(" in prompt else "wrong body"
        return "BODY: Invoice.total" if "Component: org.demo.billing |" in prompt else "BODY: no.such" if "Demo.Store" in prompt else "plain"

    told = {r.node_id: r.summary for r in cli.analyze(spark, SHOP, str(out / "d"), model=model).summaries.where("tier = 4").collect()}
    assert told["billing|billing|org.demo.billing"] == "told from the body" and "types" in told["store|store/Api|Demo.Store"]
    asked = spark.createDataFrame([(4, "billing|billing|org.demo.billing", 0, "BODY: org.demo.billing.Invoice")], "tier int, node_id string, chunk long, text string")
    small = tiers.body_prompts(asked, run.symbols, S.read_sources(spark, SHOP), limit=300)
    sizes = [r.tokens for r in small.collect()]
    assert len(sizes) > 1 and max(sizes) < 300


def test_a_long_line_loses_its_documentation_before_its_name(run):
    from pyspark.sql import functions as F

    wide = run.symbols.withColumn("docstring", F.lit("word" * 100 + "."))
    lines = "".join(r.skeleton for r in tiers.chunks(wide, 40).collect()).splitlines()
    assert any(x.startswith("    * total(2 parameters)") for x in lines) and not any("word" in x for x in lines)


def test_tree_and_code_on_pages(run, out):
    site = out / "a/wiki"
    tree = {p.name: p.read_text() for p in (site / "nav").glob("*.html")}
    assert len(tree) == 3 and "billing" in tree["index.html"] and "store" in tree["index.html"]
    assert any("<summary>org.demo.billing</summary>" in x and ">Invoice</a>" in x for x in tree.values())
    page = next(p for p in site.glob("symbols/*.html") if p.name.startswith("org.demo.billing.invoice-")).read_text()
    assert '<i class="k">class</i> Invoice' in page and 'src="../nav/index.html"' in page
    assert re.search(r'total\(<a href="../symbols/org.demo.billing.tax.taxes-\w+.html">Taxes</a> ', page)  # a parameter's type
    assert ">@Override @Cached(name = total, seconds = 5) total(" in page


def test_enclosing_symbols(spark, run, out, capsys):
    path = "billing/src/main/java/org/demo/billing/Invoice.java"
    places = spark.createDataFrame([(path, 18), (path, 1), ("none.java", 1)], "path string, line long")
    found = {(r.path, r.line): r.symbolId for r in index.enclosing(run.symbols, places).collect()}
    assert found[path, 18] == "org.demo.billing.Invoice.total(Taxes,int...)" and ("none.java", 1) not in found
    assert cli.main(["at", str(out / "a"), f"{path}:18"]) == 0
    assert capsys.readouterr().out.split()[:2] == [f"{path}:18", "org.demo.billing.Invoice.total(Taxes,int...)"]


def test_site_links_and_reproducibility(spark, run, out):
    # Last, as the second run replaces the tables of the first.
    site = out / "a/wiki"
    pages = [p for p in site.rglob("*.html")]
    assert {"index.html", "tech.html", "tests.html", "architecture.html"} <= {p.name for p in pages}
    for page in pages:
        for link in re.findall(r'(?:href|src)="([^"#]+)"', page.read_text()):
            assert (page.parent / link).resolve().exists(), (page, link)
    assert "addsUp" not in (site / "index.html").read_text() and "InvoiceTest" in (site / "tests.html").read_text()
    (site / "symbols/stale.html").write_text("old")
    first = {p.relative_to(out / "a"): p.read_bytes() for p in (out / "a").rglob("*.*") if p.suffix in (".html", ".json", ".js") and p.name != "stale.html"}
    cli.analyze(spark, SHOP, str(out / "a"))
    assert not (site / "symbols/stale.html").exists()
    assert {p.relative_to(out / "a"): p.read_bytes() for p in (out / "a").rglob("*.*") if p.suffix in (".html", ".json", ".js")} == first


def test_ancestors_of_a_deep_chain(spark):
    from codestrata.operators import index

    edges = spark.createDataFrame([(f"T{i}", f"T{i + 1}", "EXTENDS", True) for i in range(24)], "src string, dst string, kind string, resolved boolean").coalesce(1)
    assert {(r.type, r.ancestor, r.depth) for r in index.ancestors(edges).collect()} == {(f"T{i}", f"T{j}", j - i) for i in range(25) for j in range(i + 1, 25)}


def test_ancestry_of_chains_and_cycles(spark):
    rows_ = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "y"), ("v", "w"), ("self", "self"), ("two", "b"), ("two", "y"), ("a", "b"), (None, "a"), ("n", None)]
    found = R.ancestry(spark.createDataFrame(rows_, "id string, parent string")).collect()
    expected = {("a", "c", 2, None), ("b", "c", 1, None), *((i, None, None, "x") for i in "xyzwv"), ("self", None, None, "self"), ("two", "c", 2, None), ("two", None, None, "x")}
    assert {(r.id, r.top, r.depth, r.cycle) for r in found} == expected and len(found) == len(expected)


def test_ancestry_of_a_chain_of_100000(spark, monkeypatch):
    rounds, plain = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: rounds.append(1) or plain(df))
    found = R.ancestry(spark.range(100_000).selectExpr("id", "id + 1 AS parent"))
    assert found.where("top = 100000 AND depth = 100000 - id AND cycle IS NULL").count() == 100_000
    assert len(rounds) <= 18


def test_ancestry_ends_soon_below_cycles(spark, monkeypatch):
    n = 20_000
    near = [(f"n{i}", f"n{(i + 1) % 4}") for i in range(4)] + [(f"a{i}", f"a{(i + 1) % 37}") for i in range(37)]
    ways = [(f"w{i}", f"w{i + 1}" if i % 50 < 49 else "n2" if i % 100 < 50 else "top") for i in range(n)] + [(f"t{i}", f"t{i + 1}" if i < 90 else "a5") for i in range(91)]
    rounds, plain = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: rounds.append(1) or plain(df))
    found = {r.id: (r.top, r.depth, r.cycle) for r in R.ancestry(spark.createDataFrame(near + ways, "id string, parent string")).collect()}
    expected = {i: (None, None, "n0" if i[0] == "n" else "a0") for i, _ in near} | {f"t{i}": (None, None, "a0") for i in range(91)}
    expected |= {f"w{i}": (None, None, "n0") if i % 100 < 50 else ("top", 50 - i % 50, None) for i in range(n)}
    assert found == expected and len(rounds) <= 10


def test_ancestry_does_not_sort_pointers_that_meet_in_one_node(spark, monkeypatch):
    plans, plain = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    found = R.ancestry(spark.range(1000).selectExpr("id", "CASE WHEN id = 0 THEN -1 ELSE 0 END AS parent"))
    assert found.where("top = -1 AND cycle IS NULL AND depth = IF(id = 0, 1, 2)").count() == 1000
    assert len(plans) == 2 and "ShuffledHashJoin" in plans[1] and "SortMergeJoin" not in plans[1]


def test_validation_names_cycles(spark):
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("c", "d"), ("d", "c"), ("e", "c"), ("m", "gone")], "id string, parent string")
    edges = spark.createDataFrame([], "src string, dst string, kind string, resolved boolean")
    assert rows(graph.validate(nodes, edges), "problem", "id") == [("cycle", "c"), ("missing parent", "m"), *(("no root above", x) for x in "cde")]


def test_calls_of_inherited_methods(spark):
    kind = "kind string, symbolId string, parentSymbolId string, name string, signature struct<parameters:array<struct<type:string,name:string>>>, calls array<struct<name:string,n_args:int>>"
    method = lambda owner, name, calls=(): ("METHOD", f"{owner}.{name}()", owner, name, ([],), [(c, 0) for c in calls])
    symbols = spark.createDataFrame([method("Top", "far"), method("Top", "near"), method("Mid", "near"), method("I", "both"), method("J", "both"), method("Low", "run", ["far", "near", "both", "other", "none"]), method("X", "other"), method("Y", "far")], kind)
    types = spark.createDataFrame([("Low", "Mid", "EXTENDS", True), ("Mid", "Top", "EXTENDS", True), ("Low", "I", "IMPLEMENTS", True), ("Low", "J", "IMPLEMENTS", True)], "src string, dst string, kind string, resolved boolean")
    found = {r.dst for r in index.call_edges(symbols, types).collect() if r.resolved}
    assert found == {"Top.far()", "Mid.near()", "I.both()", "X.other()"}
    assert {r.dst for r in index.call_edges(symbols).collect()} == {"far/0", "near/0", "both/0", "X.other()"}


def _shuffled(spark, after=-1):
    """The last stage, and the rows that stages after another one have shuffled."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    told = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    stages = [told.apply(i) for i in range(told.size())]
    return max((s.stageId() for s in stages), default=-1), sum(s.shuffleWriteRecords() for s in stages if s.stageId() > after)


def test_calls_meet_ancestors_in_parts(spark, monkeypatch):
    n_types, names = 30, [f"m{i}" for i in range(300)]
    kind = "kind string, symbolId string, parentSymbolId string, name string, signature struct<parameters:array<struct<type:string,name:string>>>, calls array<struct<name:string,n_args:int>>"
    has = {t: names if t == 0 else names[::7] if t % 10 == 0 else [] for t in range(n_types)}
    methods = [("METHOD", f"T{t}.{m}", f"T{t}", m, ([],), []) for t, own in has.items() for m in own]
    callers = [("METHOD", f"T{t}.run", f"T{t}", "run", ([],), [(m, 0) for m in [*names, "run", "gone"]]) for t in range(n_types)]
    types = spark.createDataFrame([(f"T{t}", f"T{t - 1}", "EXTENDS", True) for t in range(1, n_types)], "src string, dst string, kind string, resolved boolean")
    above = index.ancestors(types)
    monkeypatch.setattr(index, "ancestors", lambda edges: above)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as large tables are joined
    try:
        start, _ = _shuffled(spark)
        found = {(r.src, r.dst) for r in index.call_edges(spark.createDataFrame(methods + callers, kind), types).collect() if r.resolved}
        _, shuffled = _shuffled(spark, start)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    nearest = {(t, m): max(u for u in range(t + 1) if m in has[u]) for t in range(n_types) for m in names}
    assert found == {(f"T{t}.run", f"T{u}.{m}") for (t, m), u in nearest.items()} | {(f"T{t}.run", f"T{t}.run") for t in range(n_types)}
    # 9,060 calls with 15 types above each would be 139,500 rows.
    assert shuffled < 90_000
