"""N-gram Jaccard join in prefix trees.

A document's set holds the hashes of its distinct shingles of ``n`` words (A-Z lower-cased); with fewer words, of the
whole sequence. Documents of equal sets are one class from the start. Two classes link when the intersection of their
sets is at least ``threshold`` percent of the union.

1. A set can only link if at least ``threshold`` percent of its shingles are in another set too. All shingles are posted,
   packed, to buckets by their hash; those that no other set has are told back to their documents, of which most are then
   done. A task posts a shingle that several of its sets have once, so that a common one fills no bucket.
2. The sets that are left, most of them near copies, are brought together by their prefixes: with all shingles in one
   order, those of the fewest sets first, two sets of a link share one of the first n - need + 1 of each, where n is the
   set's size and ``need`` the least overlap of a link. Sets that share one form a cluster. No link is lost. Shingles of
   more than one in ``HOT`` of all postings are counted without a shuffle, and meet in parts, so that none fills a task.
3. A cluster's sets, in one global order of shingles (frequent ones first, so that paths are shared), are stored in a
   prefix tree whose runs of single children are one node. A set is joined by walking the tree: the overlap counted on
   a path serves all sets below it, and a subtree is left when the overlap so far and the shorter remainder cannot
   reach the threshold for any size below it. Pairs that are known to be connected are not compared again.
4. A cluster of more than ``CLUSTER`` shingles is split into blocks; each block is joined with a few leaders of the
   cluster first, and what the leaders have not connected is then joined with every block.

Buckets are parts of bounded size, whatever the input's size or the number of partitions: a large one is dealt into parts
where it lies. Results for odd input: null or empty texts have no shingle and are linked with nothing; so are rows with a
null ``doc_id``; rows of one id are one document if their sets are equal; an empty table gives no rows; a very long text
is hashed a segment at a time, and its set, of 8 bytes a shingle, is held by one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Words, batch_of, bounded, cut, gram_hashes, grouped, mix, pieces, segments, shuffle_width, text_bytes
from .components import components

#: Shingles of a cluster's sets that one task joins, and the leaders of a larger cluster.
CLUSTER = 1_500_000
LEADERS = 8
#: Shingles whose counts are broadcast, at most, and sets that meet the least one of a shingle in one place.
HOT, PART = 50_000, 10_000
#: Bytes of a shingle's hash that sets are compared by.
SHINGLE_BYTES = 6
#: Ids that are broadcast at most (8 bytes each).
BROADCAST = 1_000_000
#: Bytes of texts whose shingles one task counts together, and bytes of postings that are dealt into such parts at once.
BUCKET_BYTES, REGROUPED = 32 << 20, 64 << 20
#: Postings that are sorted together.
SORTED = 1 << 19
#: Common shingles that a task remembers to have told.
TOLD = 1 << 18
#: Bytes for the marks of sets that walk a tree together.
MARKS = 64 << 20
#: Sets that walk a tree together, at first and then.
PROBES = (8, 128)

_SALT = np.uint64(0xA0761D6478BD642F)
_OWN = np.dtype([("doc_id", "<i8"), ("known", "?"), ("size", "<i8"), ("key", "<u8")])
_WHO = np.dtype([("chunk", "<i8"), ("key", "<u8"), ("doc", "<u2")])
_POSTED = ["bucket", "chunk", "own", "who", "count", "tokens", "common"]
_REPLY = pa.schema([("chunk", pa.int64()), ("own", pa.binary()), ("doc", pa.binary()), ("count", pa.binary())])


def _high(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(32)).astype(np.int64)


def _low(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32)


@dataclass
class Sets:
    """The sets of some texts: shingles by text and value, sizes, and a key of each set's content."""

    shingles: np.ndarray
    of: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray

    @classmethod
    def of_texts(cls, texts: list[bytes], n: int) -> Sets:
        if len(texts) == 1 and len(texts[0]) > 2 * CHUNK_BYTES:
            return cls.of_long_text(texts[0], n)
        words = Words(texts, lower=True)
        grams = gram_hashes(words.hashes, n)
        whole = np.arange(len(grams)) - words.first[words.of[: len(grams)]] <= words.counts[words.of[: len(grams)]] - n
        hashes, of = grams[whole], words.of[: len(grams)][whole]
        few = np.flatnonzero((words.counts > 0) & (words.counts < n))
        if len(few):
            short = [mix(gram_hashes(words.hashes[f : f + c], int(c)) + np.uint64(c)) for f, c in zip(words.first[few], words.counts[few], strict=True)]
            hashes, of = np.concatenate([hashes, *short]), np.concatenate([of, few])
        order = np.lexsort((hashes, of))
        hashes, of = hashes[order], of[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])) if len(of) else np.empty(0, bool)
        hashes, of = hashes[new], of[new]
        sizes = np.bincount(of, minlength=len(texts))
        there = np.flatnonzero(sizes)
        keys = np.zeros(len(texts), np.uint64)
        if len(there):
            first = np.cumsum(sizes[there]) - sizes[there]
            keys[there] = mix(np.add.reduceat(mix(hashes ^ _SALT), first) + sizes[there].astype(np.uint64))
        return cls(hashes, of, sizes, keys)

    @classmethod
    def of_long_text(cls, text: bytes, n: int) -> Sets:
        """The same for one long text, whose words are hashed a segment at a time."""
        last, grams, total = np.empty(0, np.uint64), [], 0
        for words in segments(text, lower=True):
            total += len(words.hashes)
            words = np.concatenate([last, words.hashes])
            grams.append(np.unique(gram_hashes(words, n)))
            last = words[max(0, len(words) - n + 1) :]
        if 0 < total < n:
            grams.append(mix(gram_hashes(last[-total:], total) + np.uint64(total)))
        hashes = np.unique(np.concatenate(grams))
        keys = mix(np.add.reduce(mix(hashes ^ _SALT), keepdims=True) + np.uint64(len(hashes))) if len(hashes) else np.zeros(1, np.uint64)
        return cls(hashes, np.zeros(len(hashes), np.int64), np.array([len(hashes)]), keys)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and how long they are."""
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


def _posted(bucket: np.ndarray, slot: np.ndarray, who: np.ndarray, tokens: np.ndarray, common_bucket: np.ndarray, common: np.ndarray) -> pa.RecordBatch:
    """Postings (``slot`` is the place of each one's set in ``who``) and common shingles as one row for each bucket."""
    order = np.argsort(bucket.astype(np.int64) * (len(who) + 1) + slot, kind="stable")
    bucket, slot, tokens = bucket[order], slot[order], tokens[order]
    start, count = _runs(bucket.astype(np.int64) * (len(who) + 1) + slot)
    order = np.argsort(common_bucket, kind="stable")
    common_bucket, common = common_bucket[order], common[order]
    targets = np.union1d(bucket, common_bucket)
    columns = []
    for of, values in ((bucket[start], who[slot[start]]), (bucket[start], count.astype("<u4")), (bucket, tokens.astype("<u4")), (common_bucket, common.astype("<u4"))):
        low, high = np.searchsorted(of, targets), np.searchsorted(of, targets, side="right")
        columns.append(pa.array([values[i:j].tobytes() for i, j in zip(low, high, strict=True)], pa.binary()))
    nothing = pa.array([b""] * len(targets), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(targets, pa.int64()), pa.array(np.zeros(len(targets)), pa.int64()), nothing, *columns], names=_POSTED)


def _first_step(docs: DataFrame, n: int, threshold: int) -> DataFrame:
    """Of each document ``doc_id``, ``n_shingles``, ``key``, and whether it ``may`` link with a document of another set."""
    coarse = shuffle_width(docs.sparkSession)
    fine = -(-text_bytes(docs) // (coarse * BUCKET_BYTES))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn = TaskContext.get().partitionId(), 0
        told = np.zeros(TOLD, np.uint64)  # shingles that this task has told to be in several sets
        for batch, texts in pieces(batches, "text"):
            sets = Sets.of_texts(texts, n)
            own = np.zeros(len(texts), _OWN)
            own["known"] = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            own["doc_id"] = batch.column(0).fill_null(0).to_numpy()
            own["size"], own["key"] = sets.sizes, sets.keys
            turn += 1
            chunk = xxhash.xxh3_64_intdigest(own.tobytes(), part << 32 | turn) >> 1
            yield pa.RecordBatch.from_arrays([pa.array([chunk % coarse], pa.int64()), pa.array([chunk], pa.int64()), *(pa.array([x], pa.binary()) for x in (own.tobytes(), b"", b"", b"", b""))], names=_POSTED)
            asking = np.flatnonzero(own["known"] & (sets.sizes > 0))
            chosen = np.zeros(len(texts), bool)
            chosen[asking[np.unique(sets.keys[asking], return_index=True)[1]]] = True
            mine = chosen[sets.of]
            tokens, of = sets.shingles[mine], sets.of[mine]
            order = np.argsort(tokens, kind="stable")
            tokens, of = tokens[order], of[order]
            start, count = _runs(tokens)
            tokens, of = tokens[start], of[start]
            new = told[(tokens % np.uint64(TOLD)).astype(np.int64)] != tokens
            common = tokens[new & (count > 1)]
            told[(common % np.uint64(TOLD)).astype(np.int64)] = common
            tokens, of = tokens[new & (count == 1)], of[new & (count == 1)]
            who = np.zeros(len(texts), _WHO)
            who["chunk"], who["key"], who["doc"] = chunk, sets.keys, np.arange(len(texts))
            yield _posted(_high(tokens) % coarse, of, who, _low(tokens), _high(common) % coarse, _low(common))

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a large bucket as rows of parts of it."""
        for held in bounded(batches, REGROUPED):
            bucket, _, own, who, count, tokens, common = ([x for b in held for x in b.column(i).to_pylist()] for i in range(7))
            for batch in held:
                yield batch.filter(pa.array([x != b"" for x in batch.column(2).to_pylist()], pa.bool_()))
            slots = np.repeat(np.array(bucket, np.int64), [len(x) // _WHO.itemsize for x in who])
            who, count, tokens, shared = (np.frombuffer(b"".join(x), k) for x, k in ((who, _WHO), (count, "<u4"), (tokens, "<u4"), (common, "<u4")))
            slot = np.repeat(np.arange(len(who)), count)
            of = np.repeat(np.array(bucket, np.int64), [len(x) // 4 for x in common])
            yield _posted(slots[slot] * fine + tokens % fine, slot, who, tokens, of * fine + shared % fine, shared)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            own = [(r[1], r[2]) for r in rows if r[2]]
            yield batch_of(_REPLY, [[c for c, _ in own], [o for _, o in own], [b""] * len(own), [b""] * len(own)])
            who, count, tokens, common = (np.frombuffer(b"".join(r[i] for r in rows), k) for i, k in ((3, _WHO), (4, "<u4"), (5, "<u4"), (6, "<u4")))
            slot = np.repeat(np.arange(len(who), dtype=np.uint32), count)
            alone, parts = np.zeros(len(who), np.int64), -(-len(tokens) // SORTED)
            for part in range(parts):  # for a bounded memory
                mine = np.flatnonzero(tokens % parts == part)
                mine = mine[np.argsort(tokens[mine], kind="stable")]
                start, count = _runs(tokens[mine])
                key = who["key"][slot[mine]]
                several = (np.minimum.reduceat(key, start) != np.maximum.reduceat(key, start)) | np.isin(tokens[mine[start]], common)
                alone += np.bincount(slot[mine[~np.repeat(several, count)]], minlength=len(who))
            hit = np.flatnonzero(alone)
            hit = hit[np.argsort(who["chunk"][hit], kind="stable")]
            start, count = _runs(who["chunk"][hit])
            places = [hit[i : i + j] for i, j in zip(start, count, strict=True)]
            yield batch_of(_REPLY, [who["chunk"][hit][start], [b""] * len(start), [who["doc"][x].tobytes() for x in places], [alone[x].astype("<u4").tobytes() for x in places]])

    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.int64()), ("may", pa.bool_())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            own, doc, count = (np.frombuffer(b"".join(r[i] for r in rows), k) for i, k in ((1, _OWN), (2, "<u2"), (3, "<u4")))
            # One row of each set has asked for all of its equals.
            keys, of = np.unique(own["key"], return_inverse=True)
            alone = np.zeros(len(keys), np.int64)
            np.add.at(alone, of[doc], count)
            may = own["known"] & (own["size"] > 0) & (100 * (own["size"] - alone[of]) >= threshold * own["size"])
            yield batch_of(schema, [pa.array(own["doc_id"], mask=~own["known"]), own["size"], own["key"].view(np.int64), may])

    ddl = "bucket long, chunk long, own binary, who binary, count binary, tokens binary, common binary"
    posted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(post, ddl).repartition("bucket")
    if fine > 1:
        posted = posted.mapInArrow(regroup, ddl)
    replies = posted.sortWithinPartitions("bucket").mapInArrow(share, "chunk long, own binary, doc binary, count binary")
    return replies.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(gather, "doc_id long, n_shingles long, key long, may boolean")


def _stars(sets: DataFrame, threshold: int) -> DataFrame:
    """Candidate pairs (a, b) of keys: b is the least of those that have one shingle in their prefixes.

    Of a set's ``n`` shingles, ordered by how many sets have them, then by value, the first ``n - need + 1`` are the
    prefix, ``need`` being the least overlap of a link. Shingles of no other set come first there, and link nothing.
    """
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("token", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, packed in pieces(batches, "shingles"):
            tokens = _unpack(b"".join(packed)).astype(np.int64)
            sizes = [len(x) // SHINGLE_BYTES for x in packed]
            yield batch_of(schema, [np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(np.array(sizes, np.int64), sizes), tokens])

    tokens = sets.select("key", "shingles").mapInArrow(spread, "key long, n long, token long")
    several = tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    total = sets.agg(F.sum(F.octet_length("shingles"))).head()[0] or 0
    # Fewer than HOT shingles can each have more than this share of all rows; theirs are counted without a shuffle.
    most = total // SHINGLE_BYTES // HOT + 1
    hot = F.broadcast(several.where(F.col("sets") > most))
    rest = tokens.join(hot.select("token"), "token", "left_anti").join(several.where(F.col("sets") <= most).hint("merge"), "token")
    counted = tokens.join(hot, "token").unionByName(rest)
    own = Window.partitionBy("key")
    turn = F.row_number().over(own.orderBy("sets", "token"))
    ranked = counted.select("*", turn.alias("turn"), F.count("*").over(own).alias("shared"))
    # The sets of one shingle meet its least in parts of some PART sets.
    parts = F.expr(f"sets div {PART} + 1")
    prefixes = ranked.where(f"turn <= shared - (n * {threshold} + 99) div 100 + 1")
    prefixes = cut(prefixes.select("token", "key", parts.alias("parts"), F.pmod(F.xxhash64("key"), parts).alias("part")))
    least = prefixes.groupBy("token", "parts").agg(F.min("key").alias("b"))
    least = least.select("token", "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return prefixes.join(least, ["token", "part"]).where("key <> b").select(F.col("key").alias("a"), "b").distinct()


class Tree:
    """A prefix tree over ordered sets, runs of single children being one node."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        #: Of each node: its run of shingles, how deep that ends, smallest and largest set below, sets that end there, children.
        self.runs: list[np.ndarray] = []
        self.depth: list[int] = []
        self.least: list[int] = []
        self.most: list[int] = []
        self.ends: list[list[int]] = []
        self.children: list[list[int]] = []
        self.roots = self._build([(i, sets[i]) for i in order], 0)

    def _node(self, run: np.ndarray, depth: int) -> int:
        self.runs.append(run)
        self.depth.append(depth)
        self.least.append(1 << 60)
        self.most.append(0)
        self.ends.append([])
        self.children.append([])
        return len(self.runs) - 1

    def _build(self, sets: list[tuple[int, np.ndarray]], depth: int) -> list[int]:
        roots: list[int] = []
        waiting = [(roots, 0, len(sets), depth)]
        while waiting:
            into, low, high, depth = waiting.pop()
            at = low
            while at < high:
                first = sets[at][1]
                token, stop = first[depth], at + 1
                while stop < high and sets[stop][1][depth] == token:
                    stop += 1
                last = sets[stop - 1][1]  # in order, so that the first and last share the least
                shared = min(len(first), len(last))
                differs = np.flatnonzero(first[depth:shared] != last[depth:shared])
                end = depth + int(differs[0]) if len(differs) else shared
                node = self._node(first[depth:end], end)
                into.append(node)
                sizes = [len(sets[i][1]) for i in range(at, stop)]
                self.least[node], self.most[node] = min(sizes), max(sizes)
                below = at
                while below < stop and len(sets[below][1]) == end:
                    self.ends[node].append(sets[below][0])
                    below += 1
                if below < stop:
                    waiting.append((self.children[node], below, stop, end))
                at = stop
        return roots

    def matches(self, probes: list[np.ndarray], universe: int, threshold: int) -> list[tuple[int, int]]:
        """Numbers of probe and stored set of all pairs that link; the tree is walked once for all probes."""
        sizes = np.array([len(p) for p in probes], np.int64)
        marks = np.zeros((universe, len(probes)), np.uint8)
        marks[np.concatenate(probes), np.repeat(np.arange(len(probes)), sizes)] = 1
        inner = [i for i, c in enumerate(self.children) if c]
        row = {node: i for i, node in enumerate(inner)}
        last = np.array([self.runs[i][-1] for i in inner], np.int64)
        #: What is left of each probe beyond each inner node.
        left = (sizes[:, None] - np.array([np.searchsorted(p, last, side="right") for p in probes]).reshape(len(probes), -1)).T
        share, found = threshold / (100 + threshold), []
        waiting = [(node, np.zeros(len(probes), np.int64)) for node in self.roots]
        while waiting:
            node, overlap = waiting.pop()
            overlap = overlap + marks[self.runs[node]].sum(axis=0, dtype=np.int64)
            for other in self.ends[node]:
                hit = 100 * overlap >= threshold * (sizes + self.sizes[other] - overlap)
                if hit.any():
                    found += [(i, other) for i in np.flatnonzero(hit).tolist()]
            if self.children[node]:
                rest, depth = left[row[node]], self.depth[node]
                best = np.clip(depth + rest, self.least[node], self.most[node])  # the size below with the best chance
                alive = overlap + np.minimum(rest, best - depth) >= share * (sizes + best) - 1e-6
                if alive.any():
                    overlap = np.where(alive, overlap, -(1 << 40))
                    waiting += [(child, overlap) for child in self.children[node]]
        return found


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def join_sets(sets: list[np.ndarray], known: list[int], stored: list[bool], probing: list[bool], threshold: int) -> list[int]:
    """The component of each set under the links between probing and stored ones; ``known`` are components before."""
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))
    stops = np.cumsum([len(s) for s in sets])
    ordered = [np.sort(x) for x in np.split(rank[inverse], stops[:-1])]
    parent = [*range(len(sets))]
    by_known: dict[int, int] = {}
    for i, c in enumerate(known):
        parent[i] = by_known.setdefault(c, i)
    numbers = [i for i, s in enumerate(stored) if s]
    if not numbers:
        return [_find(parent, i) for i in parent]
    tree = Tree([ordered[i] for i in numbers])
    waiting = [i for i, p in enumerate(probing) if p]
    # A pair of two components has a side outside the largest one, so that its members need not ask.
    both_ways, most = all(stored) and all(probing), PROBES[0]
    while waiting:
        roots = [_find(parent, i) for i in range(len(sets))]
        largest = max((n, r) for r, n in Counter(roots).items())[1] if both_ways else -1
        asking = [i for i in waiting if roots[i] != largest][:most]
        if not asking:
            break
        for i, found in tree.matches([ordered[i] for i in asking], len(values), threshold):
            a, b = _find(parent, asking[i]), _find(parent, numbers[found])
            parent[b] = a
        asked = set(asking)
        waiting = [i for i in waiting if i not in asked]
        most = max(1, min(PROBES[1], MARKS // len(values)))
    return [_find(parent, i) for i in range(len(sets))]


def _unpack(shingles: bytes) -> np.ndarray:
    whole = np.zeros((len(shingles) // SHINGLE_BYTES, 8), np.uint8)
    whole[:, :SHINGLE_BYTES] = np.frombuffer(shingles, np.uint8).reshape(-1, SHINGLE_BYTES)
    return whole.view("<u8").ravel().astype(np.uint64)


def _join_groups(rows: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of keys that one component of a group holds, as stars. Role 0: stored and probing, 1: probing, 2: stored."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in grouped(batches):
            rows = [*{(k, r): (k, c, r, s) for _, k, c, r, s in held}.values()]  # repeated rows
            keys = [k for k, _, _, _ in rows]
            found = join_sets([_unpack(s) for *_, s in rows], [c for _, c, _, _ in rows], [r != 1 for _, _, r, _ in rows], [r != 2 for _, _, r, _ in rows], threshold)
            pairs = {(k, keys[c]) for k, c in zip(keys, found, strict=True) if k != keys[c]}
            yield batch_of(schema, [[a for a, _ in pairs], [b for _, b in pairs]])

    return rows.repartition("grp").sortWithinPartitions("grp", "key").mapInArrow(run, "a long, b long")


def _shingled(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """``members`` (doc_id, key and more) with each one's set, turned from its text again.

    Repeated rows give a set more than once. Texts that are not asked for stay out of the shuffle while the ids are few.
    """
    texts = docs.select("doc_id", "text")
    if members.count() < BROADCAST:
        texts = texts.join(F.broadcast(members.select("doc_id")), "doc_id", "left_semi")
    joined = texts.join(members.hint("merge"), "doc_id").select("text", "key", F.struct(*members.columns).alias("member"))
    schema = joined.schema["member"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            sets = Sets.of_texts(texts, n)
            stops = np.cumsum(sets.sizes)
            own = sets.keys.view(np.int64) == batch.column(1).to_numpy()
            short = np.ascontiguousarray(sets.shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHINGLE_BYTES])
            shingles = [short[b - c : b].tobytes() for b, c in zip(stops, sets.sizes, strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(2), pa.array(shingles, pa.binary())], names=["member", "shingles"])
            yield out.filter(pa.array(own))

    return joined.mapInArrow(run, f"member {schema}, shingles binary").select("member.*", "shingles")


def linked(docs: DataFrame, n: int, threshold: int, cluster: int = CLUSTER) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the least id reachable by links, of every document."""
    return _linked(docs, n, threshold, cluster).select("doc_id", "n_shingles", "component_id")


def _linked(docs: DataFrame, n: int, threshold: int, cluster: int = CLUSTER) -> DataFrame:
    """``linked`` with the ``key`` of each document's set."""
    base = cut(_first_step(docs, n, threshold))
    classes = base.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.min("may").alias("may"))
    asking = cut(classes.where("may").select("doc_id", "key", "n"))
    sets = cut(_shingled(docs, asking, n))
    clusters = components(_stars(sets, threshold)).withColumnRenamed("node", "key").join(asking.select("key", "n"), "key")
    sizes = clusters.groupBy("component").agg(F.ceil(F.sum("n") / cluster).alias("blocks"))
    members = cut(clusters.join(sizes, "component").select("key", "component", "blocks"))
    sets = sets.select("key", "shingles").join(members, "key")
    many = not members.where("blocks > 1").isEmpty()
    if many:
        sets = cut(sets)
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    home = F.concat_ws(":", "component", block)
    rows = sets.select(home.alias("grp"), "key", F.col("key").alias("known"), F.lit(0).alias("role"), "shingles")
    if many:
        turn = F.row_number().over(Window.partitionBy("component").orderBy("key"))
        chosen = members.where("blocks > 1").withColumn("turn", turn).where(F.col("turn") <= LEADERS).select("key")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        leaders = sets.join(chosen, "key", "left_semi").select("component", "key", "shingles", "blocks", every)
        leaders = leaders.where(F.col("block") != F.pmod(F.xxhash64("key"), F.col("blocks")))
        rows = rows.unionByName(leaders.select(F.concat_ws(":", "component", "block").alias("grp"), "key", F.col("key").alias("known"), F.lit(0).alias("role"), "shingles"))
    links = cut(_join_groups(rows, threshold))
    joined = components(links).withColumnRenamed("node", "key").withColumnRenamed("component", "joined")
    if many:
        # Who meets whom is worked out without the sets, which are then joined once.
        large = members.where("blocks > 1").select("component", "key", "blocks").join(joined, "key", "left").withColumn("joined", F.coalesce("joined", "key"))
        weights = large.groupBy("component", "joined").agg(F.count("*").alias("w"))
        main = weights.groupBy("component").agg(F.max_by("joined", F.struct("w", "joined")).alias("main"))
        large = large.join(main, "component")
        outside = large.where("joined <> main").withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")))
        probes = outside.select("component", "part", "key", "joined", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"))
        asked = outside.select("component", "part").distinct()
        stored = large.withColumn("block", block).join(asked, "component").select("component", "part", "key", "joined", "block", F.lit(2).alias("role"))
        meeting = probes.unionByName(stored).select(F.concat_ws(":", "component", "part", "block").alias("grp"), "key", F.col("joined").alias("known"), "role")
        second = meeting.join(sets.select("key", "shingles"), "key").select("grp", "key", "known", "role", "shingles")
        links = links.unionByName(cut(_join_groups(second, threshold)))
        joined = components(links).withColumnRenamed("node", "key").withColumnRenamed("component", "joined")
    labelled = classes.select("key", "doc_id").join(joined, "key", "left").withColumn("joined", F.coalesce("joined", "key"))
    least = labelled.groupBy("joined").agg(F.min("doc_id").alias("component_id"))
    by_key = labelled.join(least, "joined").select("key", "component_id")
    out = base.join(by_key, "key", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", "key", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _with_key(docs: DataFrame, n: int) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, with the ``key`` of its set and its ``doc_id``."""
    packed = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(Sets.of_texts(texts, n).keys.view(np.int64))], names=["row", "key"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, key long").withColumn("doc_id", F.col("row.doc_id"))


def keep_one(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` with only the smallest ``doc_id`` of each component.

    The ids that go are broadcast while they are fewer than ``BROADCAST``; more are joined by a shuffle. Where an id also
    has a row with another text that stays, its rows are told apart by the keys of their sets.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    goes = F.col("component_id") != F.col("doc_id")
    found = _linked(docs, n, threshold).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.bool_and(goes).alias("whole"), F.collect_set(F.when(goes, F.col("key"))).alias("keys"))
    gone = cut(found.where(F.size("keys") > 0))
    count, mixed = gone.count(), gone.where(~F.col("whole"))
    ids = gone.select("doc_id")
    out = docs.join(F.broadcast(ids) if count < BROADCAST else ids, "doc_id", "left_anti").select(*columns)
    if mixed.isEmpty():
        return out
    several = docs.join(mixed.select("doc_id"), "doc_id", "left_semi").select(*columns)
    stay = _with_key(several, n).join(mixed.select("doc_id", F.explode("keys").alias("key")), ["doc_id", "key"], "left_anti")
    return out.unionByName(stay.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))
