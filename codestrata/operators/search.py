"""An inverted index in blocks of bounded size, prefix lookup, top-k retrieval that skips blocks, and the index as a tree of small files.

Documents have numbers: whole numbers that they have as ids, or ``numbered`` gives them dense ones in the order of their keys. A posting is a term, a document's number and a weight; a term's postings lie
in blocks, one for each ``RANGE`` numbers, sorted and as differences, so that no row holds the whole list of a frequent term and a block
is dealt by term and range, never by the term alone.

Retrieval adds up weights. The largest weight of each block bounds what a range of documents can reach; ranges are read from the best bound
down, and those whose bound cannot reach the k-th score (ties to smaller numbers) are never read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut

#: Documents of a block.
RANGE = 4096
#: Bytes of a file of the index tree, entries of one of its inner nodes, and names in a file of names.
LEAF_BYTES, FAN_OUT, NAMES = 64 << 10, 256, 512
#: After any term with the same beginning.
LAST = "\U0010ffff"


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Each distinct ``key`` with its ``number`` from 0 in ascending order; only a count for each partition comes to the driver."""
    place = F.monotonically_increasing_id()
    ordered = cut(rows.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("place", place))
    parts = ordered.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, shift = 0, []
    for row in parts:
        shift.append((row["part"], before - (row["part"] << 33)))
        before += row["n"]
    shifts = rows.sparkSession.createDataFrame(shift, "part long, shift long")
    return ordered.join(F.broadcast(shifts), F.shiftright("place", 33) == F.col("part")).select(key, (F.col("place") + F.col("shift")).alias("number"))


def terms_of(text: Column, pattern: str = "[a-z0-9]{2,}") -> Column:
    """The terms of a text in lower case, with a border where a small letter meets a capital one."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2")), F.lit(pattern), F.lit(0))


def postings(texts: DataFrame, terms: Column) -> DataFrame:
    """``term``, ``number`` and ``weight`` 1 of texts, one row for each ``number``, with an array of terms."""
    return texts.select("number", F.explode(F.array_distinct(terms)).alias("term"), F.lit(1).cast("long").alias("weight"))


def counted_postings(texts: DataFrame, text: Column, pattern: str) -> DataFrame:
    """``term``, ``number`` and how often the term (what the pattern finds) occurs, of texts with one row for each ``number``.

    Terms are counted inside their row, so that nothing is shuffled before postings meet in their blocks.
    """
    schema = pa.schema([("term", pa.string()), ("number", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for number, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Counter(find(value.as_py() or ""))
                out[0].extend(found)
                out[1].extend([number] * len(found))
                out[2].extend(found.values())
                if len(out[0]) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                    out = ([], [], [])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return texts.select(F.col("number").cast("long"), text.alias("text")).where("number IS NOT NULL").mapInArrow(run, "term string, number long, weight long")


def blocks(posted: DataFrame) -> DataFrame:
    """``term``, ``range``, ``n``, ``first``, ``last``, ``most`` (the largest weight), ``gaps`` and ``weights`` of each block.

    ``gaps`` are the differences of ascending numbers, from the beginning of the range on. A block holds ``RANGE`` postings at most. Tasks put
    together what they have of a block, each posting as one number, before it is sent.
    """
    start = F.expr(f"floor(number / {RANGE})")
    packed = F.shiftleft(F.col("number") - start * RANGE, 48).bitwiseOR(F.col("weight"))
    held = posted.groupBy("term", start.alias("range")).agg(F.sort_array(F.collect_list(packed)).alias("p"))
    number = lambda x: F.shiftright(x, 48)
    weights = F.transform("p", lambda x: x.bitwiseAND((1 << 48) - 1))
    gaps = F.transform("p", lambda x, i: number(x) - F.when(i == 0, 0).otherwise(number(F.get("p", i - 1))))
    base, n = F.col("range") * RANGE, F.size("p")
    return held.select("term", "range", n.cast("long").alias("n"), (base + number(F.col("p")[0])).alias("first"), (base + number(F.element_at("p", -1))).alias("last"), F.array_max(weights).alias("most"), gaps.alias("gaps"), weights.alias("weights"))


def store(found: DataFrame, path: str) -> DataFrame:
    """Blocks as a table in order of terms, so that a reader of some terms skips the rest by the files' statistics."""
    found.repartitionByRange("term", "range").sortWithinPartitions("term", "range").write.mode("overwrite").parquet(path)
    return found.sparkSession.read.parquet(path)


def unpacked(found: DataFrame) -> DataFrame:
    """``term``, ``number`` and ``weight`` of the postings in blocks."""
    schema = pa.schema([("term", pa.string()), ("number", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps, weights = batch.column(2), batch.column(3)
            sizes = np.diff(gaps.offsets.to_numpy())
            sums = np.cumsum(gaps.flatten().to_numpy())
            before = np.append(0, sums)[np.cumsum(sizes) - sizes]  # what was summed up before each block
            start = batch.column(1).to_numpy() * RANGE
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(sums + np.repeat(start - before, sizes)), weights.flatten()], schema=schema)

    return found.select("term", "range", "gaps", "weights").mapInArrow(run, "term string, number long, weight long")


def lookup(found: DataFrame, prefix: str) -> DataFrame:
    """Postings of all terms that begin with ``prefix``: a range of sorted terms."""
    return unpacked(found.where((F.col("term") >= prefix) & (F.col("term") < prefix + LAST)))


@dataclass
class TopK:
    """The best documents with their scores, and what was read for them."""

    best: list[tuple[int, int]]
    blocks_read: int
    blocks_met: int
    rounds: int


def top_k(found: DataFrame, terms: list[str], k: int, first: int = 4) -> TopK:
    """The ``k`` documents with the largest sum of the weights of the given terms, ties to smaller numbers.

    Rounds read ``first`` ranges, then twice as many, and so on, best bounds first; they end when no bound left can reach the k-th score.
    """
    asked = found.where(F.col("term").isin(sorted({t.lower() for t in terms})))
    bounds = cut(asked.groupBy("range").agg(F.sum("most").alias("bound"), F.count("*").alias("n")))
    met, read, rounds, best = bounds.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0], 0, 0, []
    left, take = bounds, first
    while k > 0:
        if len(best) == k:  # of ranges that can only draw level, those with smaller numbers
            number, score = best[-1]
            left = left.where((F.col("bound") > score) | ((F.col("bound") == score) & (F.col("range") <= number // RANGE)))
        rows = left.orderBy(F.desc("bound"), "range").limit(take).collect()
        if not rows:
            break
        end = rows[-1]
        left = left.where((F.col("bound") < end["bound"]) | ((F.col("bound") == end["bound"]) & (F.col("range") > end["range"])))
        chosen = found.sparkSession.createDataFrame([(r["range"],) for r in rows], "range long")
        scored = unpacked(asked.join(F.broadcast(chosen), "range")).groupBy("number").agg(F.sum("weight").alias("score"))
        more = scored.orderBy(F.desc("score"), "number").limit(k).collect()
        best = sorted([*best, *((r["number"], r["score"]) for r in more)], key=lambda x: (-x[1], x[0]))[:k]
        read, rounds, take = read + sum(r["n"] for r in rows), rounds + 1, min(2 * take, 4096)
    return TopK(best, read, met, rounds)


def retrieve(texts: DataFrame, key: str, terms: Column, asked: list[str], k: int) -> DataFrame:
    """``key`` and ``score`` (how many of the asked terms it has) of the ``k`` best rows, ties to smaller keys, by an index made for the question."""
    numbers = cut(numbered(texts, key))
    found = cut(blocks(postings(texts.select(key, terms.alias("t")).join(numbers, key), F.col("t"))))
    best = texts.sparkSession.createDataFrame(top_k(found, asked, k).best, "number long, score long")
    return numbers.join(F.broadcast(best), "number").select(key, "score")


# ---- The index as files ---------------------------------------------------------------------------------------------------


def _file(name: str, entries: list) -> str:
    """A file of the tree: a script, because a page that is opened as a file may not fetch."""
    return f"NODE({json.dumps(name)},{json.dumps(entries, separators=(',', ':'), ensure_ascii=False)});\n"


def _packed(level: int, most_bytes: int, most_entries: int):
    """Sorted (term, entry as JSON) as files of bounded size: term of the first entry, name, script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, at, part = [], 0, 0, TaskContext.get().partitionId()

        def file() -> pa.RecordBatch:
            nonlocal held, size, at
            name = f"{level}-{part}-{at}"
            out = pa.RecordBatch.from_pydict({"term": [held[0][0]], "name": [name], "script": [_file(name, [e for _, e in held])]})
            held, size, at = [], 0, at + 1
            return out

        for batch in batches:
            for term, entry in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (size + len(entry) > most_bytes or len(held) == most_entries):
                    yield file()
                held.append((term, json.loads(entry)))
                size += len(entry)
        if held:
            yield file()

    return run


def tree_files(found: DataFrame) -> DataFrame:
    """``rel_path`` and ``html`` of the files of a search tree over blocks: leaves, inner nodes, and ``search/root.js``.

    A leaf has entries [term, first number, differences...]; an inner node has [first term of a child, its name]. A page finds a prefix by
    loading one node of each level and the leaves that hold terms with it, one after another, as hits are asked for.
    """
    spark, level, out = found.sparkSession, 0, None
    gaps = F.transform("gaps", lambda x, i: F.when(i == 0, F.col("first")).otherwise(x))
    entries = found.select("term", F.col("range").alias("then"), F.to_json(F.struct(F.array("term").alias("t"), gaps.alias("g"))).alias("entry"))
    entries = entries.select("term", "then", F.regexp_replace("entry", r'^\{"t":\[(.*)\],"g":\[(.*)\]\}$', "[$1,$2]").alias("entry"))
    while True:
        dealt = entries.repartitionByRange("term", "then") if level < 2 else entries.coalesce(1)  # the third level is 10^4 times smaller
        files = cut(dealt.sortWithinPartitions("term", "then").select("term", "entry").mapInArrow(_packed(level, LEAF_BYTES, 1 << 30 if not level else FAN_OUT), "term string, name string, script string"))
        shown = files.select(F.concat(F.lit("search/"), "name", F.lit(".js")).alias("rel_path"), F.col("script").alias("html"))
        out = shown if out is None else out.unionByName(shown)
        many = files.limit(2).collect()
        if len(many) < 2:
            break
        place = F.split("name", "-")
        then = F.shiftleft(place[1].cast("long"), 32) + place[2].cast("long")
        name = F.to_json(F.struct(F.array("term", "name").alias("x")))
        entries = files.select("term", then.alias("then"), F.regexp_replace(name, r'^\{"x":(.*)\}$', "$1").alias("entry"))
        level += 1
    top = [(json.dumps(many[0]["name"] if many else ""),)]
    root = spark.createDataFrame(top, "name string").select(F.lit("search/root.js").alias("rel_path"), F.concat(F.lit('NODE("root",'), "name", F.lit(");\n")).alias("html"))
    return out.unionByName(root)


def name_files(numbers: DataFrame, key: str) -> DataFrame:
    """``rel_path`` and ``html`` of files that tell the names of ``NAMES`` numbers each."""
    group = F.expr(f"number div {NAMES}")
    names = F.transform(F.array_sort(F.collect_list(F.struct("number", key))), lambda x: x[key])
    held = numbers.groupBy(group.alias("g")).agg(F.to_json(names).alias("names"))
    name = F.concat(F.lit("n-"), F.col("g").cast("string"))
    return held.select(F.concat(F.lit("search/"), name, F.lit(".js")).alias("rel_path"), F.concat(F.lit('NODE("'), name, F.lit('",'), "names", F.lit(");\n")).alias("html"))


#: Walks the tree: ``load(name)`` promises a node's entries; ``found`` gets each page once and tells, by false, that enough is shown.
SEARCH = """
async function lookup(load, prefix, found) {
  const end = prefix + '\\u{10ffff}', seen = new Set();
  async function names(number) { return (await load('n-' + Math.floor(number / NAMES)))[number % NAMES]; }
  async function walk(name) {
    const leaf = name.startsWith('0-'), entries = await load(name);
    for (let i = 0; i < entries.length; i++) {
      const term = entries[i][0];
      if (term >= end) return true;
      if (!leaf) {
        const past = i + 1 < entries.length && entries[i + 1][0] < prefix;
        if (!past && !(await walk(entries[i][1]))) return false;
      } else if (term.startsWith(prefix)) {
        let number = 0;
        for (let j = 1; j < entries[i].length; j++) {
          number += entries[i][j];
          if (seen.has(number)) continue;
          seen.add(number);
          if (!(await found(await names(number)))) return false;
        }
      }
    }
    return true;
  }
  const root = await load('root');
  return root ? walk(root) : true;
}
""".replace("NAMES", str(NAMES))
#: The search box: nodes are scripts, loaded when they are needed; more hits are shown on demand, as many as there are.
BOX = """
const nodes = {}, waiting = {}, box = document.querySelector('#search'), hits = document.querySelector('#hits'), up = document.body.dataset.up;
function NODE(name, entries) { nodes[name] = entries; (waiting[name] || []).forEach(f => f(entries)); delete waiting[name]; }
function load(name) {
  if (name in nodes) return Promise.resolve(nodes[name]);
  return new Promise(done => {
    if (waiting[name]) { waiting[name].push(done); return; }
    waiting[name] = [done];
    const s = document.createElement('script'); s.src = up + 'search/' + name + '.js'; document.head.append(s);
  });
}
let turn = 0;
box.addEventListener('input', () => {
  const q = box.value.toLowerCase(), mine = ++turn; hits.innerHTML = ''; let shown = 0;
  if (q.length < 2) return;
  lookup(load, q, async page => {
    if (mine !== turn) return false;
    const li = document.createElement('li'), a = document.createElement('a'); a.href = up + page; a.textContent = page; li.append(a); hits.append(li);
    if (++shown % 30) return true;
    const more = document.createElement('button'); more.textContent = 'More'; hits.append(more);
    await new Promise(f => more.addEventListener('click', f)); more.remove();
    return mine === turn;
  });
});
"""
