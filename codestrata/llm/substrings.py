"""Substring dedup by suffix automata of reference shards, which other documents' words are streamed through.

A window is ``width`` consecutive words of one document. A word is removed if a window that covers it also starts in a
document with a smaller ``doc_id``. Each window is represented by its minimizer, the least hash of the runs of
``GRAM`` words in it, so that equal windows have equal minimizers; consecutive windows with one minimizer form a run.

1. Postings (minimizer, document) are dealt by minimizer, and those of two documents or more go back to their documents.
   A minimizer of ``COMMON`` documents or more in one batch of a task becomes common everywhere; a task posts it once,
   as long as it remembers it (``TOLD``).
2. Documents send the words of their runs with such minimizers to the shard of that minimizer, or, of a common one, each
   window to the shard of its own hash. Of equal segments in a batch only the smallest document's is sent, and of
   common windows that a task has sent before only a smaller document's; the others are found by that, and go straight
   back to their documents, as maximal spans. A passage of all documents thus reaches its shard once for each task.
3. A shard goes through each minimizer's segments in order of documents, equal ones (of one hash) being one. Their words are streamed through the suffix
   automaton of what smaller documents brought; where the matching statistic reaches ``width``, a window is found. Only
   then does the segment itself join the automaton.
4. The maximal spans found are taken out of the documents.

The reference is the whole corpus, so its automata are dealt over the cluster and segments are routed to them, instead of
being broadcast, which would have no size bound. Words are compared by 40 bits of their hashes.

Results for odd input: null texts count as empty and have no words; of documents with one id none removes from another;
rows with a null ``doc_id`` are kept whole and take no part; texts of fewer than ``width`` words have no window; an empty
table gives no rows. Postings and segments are held a bucket at a time, with as many buckets as the texts' bytes need. One
text's words, however long it is, are hashed in one task, which takes some 60 bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, batch_of, deal, gather, gram_hashes, grouped, mix, pieces, raw_bytes, shuffle_width, text_bytes, undeal

GRAM = 6
#: Documents in a batch, and postings in all, from which a minimizer is common.
COMMON, COMMON_ALL = 8, 2000
#: Common minimizers, and common windows, that a task remembers; forgotten ones are only sent again.
TOLD = 1 << 16
#: Bytes of texts whose postings and segments one task holds together, on average.
BUCKET_BYTES = 8 << 20
#: Bytes of a word's hash that segments carry.
WORD_BYTES = 5

_ONE = np.uint64(1)
_PACKED = "bucket int, kind int, key binary, doc binary, text binary, start binary, n binary, flat binary"


def windows(words: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows start (numbers of words), and each one's minimizer without its lowest bit."""
    grams = gram_hashes(words.hashes, gram)
    there = np.flatnonzero(np.arange(len(words.hashes)) - words.first[words.of] <= words.counts[words.of] - width) if len(words.hashes) else np.empty(0, np.int64)
    if not len(there):
        return there, np.empty(0, np.uint64)
    span, least, done = width - gram + 1, grams, 1
    while 2 * done <= span:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < span:
        least = np.minimum(least[: len(least) - (span - done)], least[span - done :])
    return there, least[there] & ~_ONE


def _shared(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket's postings, the documents that are told of a minimizer which two have, and that with its mark."""
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    plain = key & ~_ONE
    starts = np.flatnonzero(np.append(True, plain[1:] != plain[:-1]))
    counts = np.diff(np.append(starts, len(key)))
    common = (np.maximum.reduceat(key & _ONE, starts) > 0) | (counts > COMMON_ALL)
    shared = common | (np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts))
    told = np.repeat(shared, counts) & ((key & _ONE) == 0)
    return doc[told], (plain | np.repeat(common, counts))[told]


def _postings(docs: DataFrame, width: int, gram: int, buckets: int) -> DataFrame:
    """Step 1: (doc_id, minimizer) of minimizers in at least two documents; the lowest bit tells common ones."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.full(TOLD, 1, np.uint64)  # no minimizer is odd
        for batch, texts in pieces(batches, "text"):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = Words(texts)
            there, least = windows(words, width, gram)
            if not len(there):
                continue
            of = words.of[there]
            new = np.append(True, (least[1:] != least[:-1]) | (of[1:] != of[:-1]))
            least, of = least[new], ids[of[new]]
            order = np.lexsort((of, least))
            least, of = least[order], of[order]
            new = np.append(True, (least[1:] != least[:-1]) | (of[1:] != of[:-1]))
            least, of = least[new], of[new]
            starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
            counts = np.diff(np.append(starts, len(least)))
            slots = ((least[starts] >> _ONE) % np.uint64(TOLD)).astype(np.int64)
            known = told[slots] == least[starts]
            new = (counts >= COMMON) & ~known
            told[slots[new]] = least[starts][new]
            common = np.repeat(known | new, counts)
            once = np.zeros(len(least), bool)
            once[starts[new]] = True
            sent = ~common | once
            key = least[sent] | common[sent]
            if sent.any():
                yield deal(((key >> _ONE) % np.uint64(buckets)).astype(np.int32), {"key": key, "doc": of[sent]})
            if common.any():
                yield deal(np.full(int(common.sum()), buckets + ids[0] % buckets, np.int32), {"key": least[common] | _ONE, "doc": of[common]})

    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64())])

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in grouped(batches):
            key, doc = undeal(rows, {"key": np.uint64, "doc": np.int64})
            if bucket < buckets:
                doc, key = _shared(key, doc)
            yield batch_of(schema, [doc, key.view(np.int64)])

    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    posted = known.mapInArrow(post, "bucket int, key binary, doc binary").repartition("bucket").sortWithinPartitions("bucket")
    return posted.mapInArrow(share, "doc_id long, mark long")


def _equal(of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (of, hashes), and where its groups start."""
    order = np.lexsort((hashes, of))
    new = np.append(True, (of[order][1:] != of[order][:-1]) | (hashes[order][1:] != hashes[order][:-1]))
    return order, np.flatnonzero(new)


class Automaton:
    """The suffix automaton of some word sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _copy(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        return len(self.link) - 1

    def _redirect(self, state: int, word, old: int, new: int) -> None:
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]

    def add(self, words: list) -> None:
        next_, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            after = next_[last].get(word)
            if after is not None:
                if length[after] != length[last] + 1:
                    copy = self._copy(after, length[last] + 1)
                    link[after] = copy
                    self._redirect(last, word, after, copy)
                    after = copy
                last = after
                continue
            next_.append({})
            link.append(0)
            length.append(length[last] + 1)
            state, at, last = len(link) - 1, last, len(link) - 1
            while at >= 0 and word not in next_[at]:
                next_[at][word] = state
                at = link[at]
            if at >= 0:
                after = next_[at][word]
                if length[after] == length[at] + 1:
                    link[state] = after
                else:
                    copy = self._copy(after, length[at] + 1)
                    link[after] = link[state] = copy
                    self._redirect(at, word, after, copy)

    def statistics(self, words: list) -> list[int]:
        """For each place the length of the longest match that ends there."""
        next_, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for word in words:
            while state and word not in next_[state]:
                state = link[state]
                matched = length[state]
            if word in next_[state]:
                state = next_[state][word]
                matched += 1
            else:
                matched = 0
            out.append(matched)
        return out


def _search(key: np.ndarray, doc: np.ndarray, n: np.ndarray, begin: np.ndarray, flat: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step 3 on one shard: the numbers of segments, and first word and number of words of the spans found in them."""
    content = np.zeros(len(key), np.uint64)
    np.add.at(content, np.repeat(np.arange(len(n)), n), mix(flat ^ (np.arange(len(flat), dtype=np.uint64) - np.repeat(begin, n).astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)))
    # Of equal segments all but the smallest document's are found whole.
    order = np.lexsort((doc, content, key))
    k, c = key[order], content[order]
    same = np.append(False, (k[1:] == k[:-1]) & (c[1:] == c[:-1]))
    starts = np.flatnonzero(~same)
    least = np.repeat(doc[order][starts], np.diff(np.append(starts, len(order))))
    whole = order[doc[order] > least]
    found = [(whole, np.zeros(len(whole), np.int64), n[whole])]
    # What is left of a minimizer with several contents goes through its automaton, document by document.
    rest = order[doc[order] == least]
    rest = rest[np.lexsort((doc[rest], key[rest]))]
    k, d = key[rest], doc[rest]
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(rest) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(rest))
    several = d[starts] != d[ends - 1] if len(rest) else np.empty(0, bool)
    at, first, size = [], [], []
    for a, b in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
        automaton, waiting, current = Automaton(), [], None
        for i in range(a, b):
            segment = int(rest[i])
            words = flat[begin[segment] : begin[segment] + n[segment]].tolist()
            if d[i] != current:
                for w in waiting:
                    automaton.add(w)
                waiting, current = [], d[i]
            if i > a:
                span = None
                for end, matched in enumerate(automaton.statistics(words), 1):
                    if matched >= width:
                        if span is not None and end - width <= span[1]:
                            span = (span[0], end)
                        else:
                            if span:
                                at.append(segment), first.append(span[0]), size.append(span[1] - span[0])
                            span = (end - width, end)
                if span:
                    at.append(segment), first.append(span[0]), size.append(span[1] - span[0])
            waiting.append(words)
    found.append((np.array(at, np.int64), np.array(first, np.int64), np.array(size, np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _spans(marked: DataFrame, width: int, gram: int, shards: int) -> DataFrame:
    """Steps 2 and 3: (doc_id, text_key, start, n) of spans of words found in smaller documents."""
    none = np.empty(0, np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Common windows that this task has sent, and the least document that it has sent each for.
        told, told_doc = np.zeros(TOLD, np.uint64), np.full(TOLD, np.iinfo(np.int64).max)
        for batch, texts in pieces(batches, "text"):
            marks = batch.column(2)
            chosen = [i for i in range(len(texts)) if marks[i].is_valid]
            if not chosen:
                continue
            ids = np.array([batch.column(0)[i].as_py() for i in chosen], np.int64)
            texts = [texts[i] for i in chosen]
            text_keys = np.array([xxhash.xxh3_64_intdigest(t) & 0x7FFFFFFF for t in texts], np.int32)
            words = Words(texts)
            there, least = windows(words, width, gram)
            if not len(there):
                continue
            of = words.of[there]
            # Which windows have a marked minimizer: marks and windows as pairs with the document.
            flat_marks = np.concatenate([marks[i].values.to_numpy() for i in chosen]).view(np.uint64)
            mark_of = np.repeat(np.arange(len(chosen)), [len(marks[i].values) for i in chosen]).astype(np.uint64)
            salt = np.uint64(0xD6E8FEB86659FD93)
            pair = mix((flat_marks & ~_ONE) + mark_of * salt)
            order = np.argsort(pair, kind="stable")
            pair, bit = pair[order], (flat_marks & _ONE)[order]
            # A minimizer may be marked common by one way and not by another: common holds.
            new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            pair, bit = pair[new], np.maximum.reduceat(bit, new)
            own = mix(least + of.astype(np.uint64) * salt)
            place = np.minimum(np.searchsorted(pair, own), len(pair) - 1)
            hit, common = pair[place] == own, bit[place] == 1
            alone = np.flatnonzero(hit & common)
            in_run = hit & ~common
            joined = np.append(False, in_run[1:] & in_run[:-1] & (least[1:] == least[:-1]) & (of[1:] == of[:-1]) & (there[1:] == there[:-1] + 1))
            run = np.flatnonzero(in_run & ~joined)
            number = np.cumsum(in_run & ~joined)[in_run] - 1
            run_size = np.bincount(number, minlength=len(run)) + width - 1
            single = gram_hashes(words.hashes, width)[there[alone]] if len(alone) else none
            begin = np.concatenate([there[run], there[alone]])
            n = np.concatenate([run_size, np.full(len(alone), width)]).astype(np.int64)
            key = np.concatenate([least[run], single | _ONE])
            which = np.concatenate([of[run], of[alone]])
            if not len(begin):
                continue
            # Of equal segments in this batch only the smallest document's are sent.
            flat = gather(words.hashes, begin, n)
            inside = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            content = np.add.reduceat(mix(flat ^ inside.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), np.cumsum(n) - n)
            order, starts = _equal(key, content)
            doc = ids[which]
            least_doc = np.empty(len(key), np.int64)
            least_doc[order] = np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.append(starts, len(order))))
            start = (begin - words.first[which]).astype(np.int32)
            window = mix(key ^ mix(content)) | _ONE
            slot = (window >> _ONE).astype(np.int64) % TOLD
            before = np.where((told[slot] == window) & (key & _ONE == 1), told_doc[slot], np.iinfo(np.int64).max)
            sent = (doc == least_doc) & (before >= doc)
            fresh = np.flatnonzero(sent & (key & _ONE == 1))
            told[slot[fresh]], told_doc[slot[fresh]] = window[fresh], doc[fresh]
            if sent.any():
                bucket = (mix(key[sent]) % np.uint64(shards)).astype(np.int32)
                columns = {"key": key[sent], "doc": doc[sent], "text": text_keys[which[sent]], "start": start[sent], "n": n[sent].astype(np.int32)}
                five = gather(words.hashes, begin[sent], n[sent]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]
                out = deal(bucket, columns, n[sent], np.ascontiguousarray(five))
                yield pa.RecordBatch.from_arrays([out.column(0), pa.array([0] * len(out), pa.int32()), *out.columns[1:]], names=[x.split()[0] for x in _PACKED.split(", ")])
            if not sent.all():
                # The others are found already: as maximal spans they go back to their documents.
                some = np.flatnonzero(~sent)
                some = some[np.argsort(begin[some], kind="stable")]
                reach = np.maximum.accumulate(begin[some] + n[some])
                first = np.flatnonzero(np.append(True, begin[some][1:] >= reach[:-1]))
                size = reach[np.append(first[1:], len(some)) - 1] - begin[some][first]
                some = some[first]
                columns = {"doc": doc[some], "text": text_keys[which[some]], "start": start[some], "n": size.astype(np.int32)}
                out = deal((mix(doc[some].view(np.uint64)) % np.uint64(shards)).astype(np.int32), columns)
                empty = pa.array([b""] * len(out), pa.binary())
                yield pa.RecordBatch.from_arrays([out.column(0), pa.array([1] * len(out), pa.int32()), empty, *out.columns[1:], empty], names=[x.split()[0] for x in _PACKED.split(", ")])

    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int32()), ("start", pa.int32()), ("n", pa.int32())])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"key": np.uint64, "doc": np.int64, "text": np.int32, "start": np.int32, "n": np.int32, "flat": np.uint8}
        for _, rows in grouped(batches):
            _, doc, text, start, n, _ = undeal([r for r in rows if r[1] == 1], kinds, 2)
            yield batch_of(schema, [doc, text, start, n])
            key, doc, text, start, n, flat = undeal([r for r in rows if r[1] == 0], kinds, 2)
            if not len(key):
                continue
            hashes = np.zeros((len(flat) // WORD_BYTES, 8), np.uint8)
            hashes[:, :WORD_BYTES] = flat.reshape(-1, WORD_BYTES)
            n = n.astype(np.int64)
            at, first, size = _search(key, doc, n, np.cumsum(n) - n, hashes.view("<u8").ravel().astype(np.uint64), width)
            yield batch_of(schema, [doc[at], text[at], start[at] + first, size])

    sent = marked.mapInArrow(send, _PACKED).repartition("bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(receive, "doc_id long, text_key int, start int, n int")


def repeated_spans(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``text``, ``spans`` (array of text_key, start, n in words; null if none), and ``rest``, a struct of
    the other columns by place, of every document.

    The texts are shuffled once: both joins use one exchange, for which both take the same columns.
    """
    gram = max(1, min(GRAM, width - 1))
    buckets = max(4 * shuffle_width(docs.sparkSession), -(-text_bytes(docs) // BUCKET_BYTES))
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(True).alias("there"), *others).alias("rest"))
    marks = _postings(rows, width, gram, buckets).groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))
    marked = rows.join(marks.hint("merge"), "doc_id", "left").select("doc_id", "text", "marks", "rest")
    found = _spans(marked, width, gram, buckets).groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "start", "n")).alias("spans"))
    return rows.join(found.hint("merge"), "doc_id", "left").select("doc_id", "text", "spans", "rest")


def _covered(words: Words, number: int, text: bytes, spans: pa.ListScalar) -> np.ndarray:
    """Which words of one text the spans cover."""
    covered = np.zeros(int(words.counts[number]), bool)
    if spans.is_valid:
        own = xxhash.xxh3_64_intdigest(text) & 0x7FFFFFFF
        rows = spans.values
        keys, starts, sizes = (rows.field(i).to_numpy() for i in range(3))
        edge = np.zeros(len(covered) + 1, np.int64)
        mine = keys == own
        np.add.at(edge, starts[mine], 1)
        np.add.at(edge, starts[mine] + sizes[mine], -1)
        covered = np.cumsum(edge)[:-1] > 0
    return covered


def digest_kept(docs: DataFrame, width: int = 13) -> DataFrame:
    """For each document how many words it has, how many are removed, and a digest of those kept."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            rows: tuple[list, list, list] = ([], [], [])
            for text, spans in zip(texts, batch.column(2), strict=True):
                words = text.split()
                if spans.is_valid:
                    covered = _covered(Words([text]), 0, text, spans).tolist()
                    kept = [w for w, c in zip(words, covered, strict=True) if not c]
                else:
                    kept = words
                rows[0].append(len(words))
                rows[1].append(len(words) - len(kept))
                rows[2].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield batch_of(schema, [batch.column(0).to_pylist(), *rows])

    return repeated_spans(docs, width).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with the words that ``digest_kept`` counts as removed taken out of ``text``; other texts stay as they are.

    What is kept before and after a removed span is joined by a space. A column ``n_chars`` follows the new text.
    """
    spans = repeated_spans(docs, width)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, shown, found in zip(raw_bytes(batch.column(1)), batch.column(1), batch.column(2), strict=True):
                if found.is_valid:
                    words = Words([text])
                    covered = _covered(words, 0, text, found)
                    if covered.any():
                        edges = np.flatnonzero(np.diff(np.concatenate([[True], covered, [True]]).astype(np.int8)))
                        stretches = zip(edges[::2], edges[1::2], strict=True)
                        kept = [text[words.starts[a] : words.starts[b - 1] + words.lengths[b - 1]] for a, b in stretches]
                        out.append(b" ".join(kept).decode())
                        continue
                out.append(shown.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, schema.field(1).type), batch.column(3)], names=["doc_id", "text", "rest"])

    kind = T.StructType([spans.schema[x] for x in ("doc_id", "text", "rest")])
    new = spans.mapInArrow(run, kind)
    names = [c for c in docs.columns]
    columns = []
    for i, c in enumerate(names):
        if c in ("doc_id", "text"):
            columns.append(F.col(c))
        elif c == "n_chars":
            columns.append(F.length("text").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("rest").getField(f"c{i}").alias(c))
    return new.select(*columns)
