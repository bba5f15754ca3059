"""The inverted index: bounded blocks, prefix lookup, top-k with skipping, and the tree of files."""

import json
import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from codestrata.operators import search


@pytest.fixture(scope="module")
def texts(spark):
    """10,000 texts: one word in all of them, some in every third, many rare ones."""
    rng = random.Random(1)
    rows = [(f"k{i:05d}", " ".join(["all", *(["third"] * rng.randint(1, 9) if i % 3 == 0 else []), *(f"w{rng.randint(0, 999)}" for _ in range(4)), *(["rare", "rare"] if i in (7001, 9000) else [])])) for i in range(10_000)]
    return rows, spark.createDataFrame(rows, "key string, text string").repartition(5).persist()


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    numbers = search.numbered(texts[1], "key").persist()
    posted = search.counted_postings(texts[1].join(numbers, "key"), F.col("text"), "[a-z0-9]{2,}")
    return numbers, search.store(search.blocks(posted), str(tmp_path_factory.mktemp("blocks")))


def test_numbers_are_dense_and_in_order(spark, texts, index):
    rows = texts[0]
    assert {r.key: r.number for r in index[0].collect()} == {k: i for i, (k, _) in enumerate(rows)}
    odd = spark.createDataFrame([(None,), ("b",), ("b",), ("a",)], "key string")
    assert sorted(map(tuple, search.numbered(odd, "key").collect())) == [("a", 0), ("b", 1)]
    assert search.numbered(odd.limit(0), "key").count() == 0


def test_no_block_holds_more_than_a_range(texts, index):
    blocks = index[1].collect()
    assert max(r.n for r in blocks) <= search.RANGE and len([r for r in blocks if r.term == "all"]) == 3
    assert all(r.n == len(r.gaps) == len(r.weights) and r.range * search.RANGE + sum(r.gaps) == r.last and r.most == max(r.weights) for r in blocks)
    expected = sorted((t, i, text.split().count(t)) for i, (_, text) in enumerate(texts[0]) for t in set(text.split()))
    assert sorted(map(tuple, search.unpacked(index[1]).collect())) == expected


@pytest.mark.parametrize("prefix", ["w1", "w99", "all", "zz", "", "r"])
def test_prefix_lookup_equals_brute_force(texts, index, prefix):
    expected = sorted((t, i) for i, (_, text) in enumerate(texts[0]) for t in set(text.split()) if t.startswith(prefix))
    assert sorted((r.term, r.number) for r in search.lookup(index[1], prefix).collect()) == expected


@pytest.mark.parametrize("terms, k", [(["all"], 5), (["All", "third"], 20), (["rare", "all"], 3), (["w5", "w6", "third", "rare", "none"], 50), (["none"], 4), (["all"], 0), (["w1"], 100_000)])
def test_top_k_equals_the_full_ranking_with_ties(texts, index, terms, k):
    asked = {t.lower() for t in terms}
    scores = [(i, sum(w in asked for w in text.split())) for i, (_, text) in enumerate(texts[0])]
    expected = sorted(((i, s) for i, s in scores if s), key=lambda x: (-x[1], x[0]))[:k]
    assert search.top_k(index[1], terms, k, first=1).best == expected


def test_blocks_that_cannot_reach_the_top_are_skipped(spark):
    """Two of 400 ranges hold the best; the others' bounds lie below."""
    n = 400
    rows = [("common", i * search.RANGE + j, 1) for i in range(n) for j in (0, 9)] + [("strong", 77 * search.RANGE + 5, 9), ("strong", 300 * search.RANGE + 1, 8), ("strong", 300 * search.RANGE + 2, 7)]
    found = search.blocks(spark.createDataFrame(rows, "term string, number long, weight long")).persist()
    got = search.top_k(found, ["common", "strong"], 3)
    assert got.best == [(77 * search.RANGE + 5, 9), (300 * search.RANGE + 1, 8), (300 * search.RANGE + 2, 7)]
    assert got.blocks_met == n + 2 and got.blocks_read <= 8 and got.rounds == 1
    first = search.top_k(found, ["common"], 2)
    assert first.best == [(0, 1), (9, 1)] and first.blocks_read <= 4  # equal bounds of larger numbers are skipped too


def test_retrieval_by_a_fresh_index(texts):
    got = sorted(map(tuple, search.retrieve(texts[1], "key", search.terms_of(F.col("text")), ["third", "w7"], 30).collect()))
    scores = [(k, len({"third", "w7"} & set(text.split()))) for k, text in texts[0]]
    assert got == sorted(sorted(((k, s) for k, s in scores if s), key=lambda x: (-x[1], x[0]))[:30])


def nodes_of(files):
    out = {}
    for path, script in files.items():
        name, entries = json.loads("[" + script.removeprefix("NODE(").removesuffix(");\n") + "]")
        assert path == f"search/{name}.js"
        out[name] = entries
    return out


def hits(nodes, prefix):
    """What the script does: (pages, names of the nodes that it loads)."""
    loaded, seen = [], {}

    def walk(name):
        loaded.append(name)
        for i, entry in enumerate(nodes[name]):
            if entry[0] >= prefix + search.LAST:
                return
            if not name.startswith("0-"):
                if not (i + 1 < len(nodes[name]) and nodes[name][i + 1][0] < prefix):
                    walk(entry[1])
            elif entry[0].startswith(prefix):
                number = 0
                for gap in entry[1:]:
                    number += gap
                    seen.setdefault(nodes[f"n-{number // search.NAMES}"][number % search.NAMES])

    if nodes["root"]:
        walk(nodes["root"])
    return list(seen), loaded


@pytest.fixture(scope="module")
def tree(index):
    files = search.tree_files(index[1]).unionByName(search.name_files(index[0], "key"))
    rows = files.collect()
    found = {r.rel_path: r.html for r in rows}
    assert len(found) == len(rows)
    return found


def test_a_prefix_loads_few_files_and_finds_all(texts, tree, monkeypatch):
    nodes = nodes_of(tree)
    assert max(map(len, tree.values())) < 3 * search.LEAF_BYTES
    for prefix in ("w12", "rare", "third", "w", "nothing"):
        found, loaded = hits(nodes, prefix)
        assert sorted(found) == sorted(k for k, text in texts[0] if any(w.startswith(prefix) for w in text.split()))
        if prefix in ("rare", "w12", "nothing"):
            assert len(loaded) <= 4


def test_a_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(search, "LEAF_BYTES", 40)
    monkeypatch.setattr(search, "FAN_OUT", 3)
    rows = [(f"t{i:03d}", j, 1) for i in range(60) for j in range(i % 4 + 1)]
    found = search.blocks(spark.createDataFrame(rows, "term string, number long, weight long"))
    numbers = spark.createDataFrame([(j, f"p{j}") for j in range(4)], "number long, key string")
    nodes = nodes_of({r.rel_path: r.html for r in search.tree_files(found).unionByName(search.name_files(numbers, "key")).collect()})
    assert max(len(v) for k, v in nodes.items() if k[0] in "123456") <= 3
    assert {k.split("-")[0] for k in nodes} > {"0", "1", "2", "root"}
    for i in range(60):
        assert hits(nodes, f"t{i:03d}")[0] == [f"p{j}" for j in range(i % 4 + 1)]
    assert sorted(hits(nodes, "t")[0]) == ["p0", "p1", "p2", "p3"]


def test_an_empty_index(spark):
    found = search.blocks(spark.createDataFrame([], "term string, number long, weight long"))
    assert {r.rel_path for r in search.tree_files(found).collect()} == {"search/root.js"}
    assert search.top_k(found, ["a"], 3).best == [] and search.lookup(found, "a").count() == 0


@pytest.mark.skipif(not shutil.which("node"), reason="needs a JavaScript engine")
def test_the_script_itself(texts, tree, tmp_path):
    (tmp_path / "files.json").write_text(json.dumps(tree))
    script = search.SEARCH + """
const files = JSON.parse(require('fs').readFileSync(process.argv[2])), loaded = [];
async function load(name) { loaded.push(name); let got; (new Function('NODE', files['search/' + name + '.js']))((n, e) => { got = e; }); return got; }
(async () => { const out = []; await lookup(load, process.argv[3], async p => { out.push(p); return out.length < +process.argv[4]; }); console.log(JSON.stringify([out, loaded.length])); })();
"""
    (tmp_path / "run.js").write_text(script)
    for prefix, most in (("rare", 99), ("w12", 9999), ("all", 35)):
        done = subprocess.run(["node", str(tmp_path / "run.js"), str(tmp_path / "files.json"), prefix, str(most)], capture_output=True, text=True, timeout=60, check=True)
        found, loaded = json.loads(done.stdout)
        expected = sorted(k for k, text in texts[0] if any(w.startswith(prefix) for w in text.split()))
        assert len(set(found)) == len(found) and (sorted(found) == expected if most > len(expected) else len(found) == most and set(found) <= set(expected))
        assert loaded < 40 + 2 * len(found)
