"""Byte-pair encoding with word ends by a contiguous rank array, and decoding.

The vocabulary file is one of the public tokenizers' (``word_bpe_49k.json``: NFC, white space to a space, lower case, a
pattern that cuts words, bytes as printable characters, merges inside words with ``</w>`` at the end). A short word's
parts and the ranks of its adjacent pairs lie in two contiguous arrays (rows of two matrices, for many words at once).
The smallest rank is looked for by a scan, its boundary is deleted, the two neighbouring ranks are refreshed, and so on
until no pair has a rank. A word of more than
``LONG_WORD`` parts, for which scans would take quadratic time, goes through a heap with the same order of merges.

Whole texts are encoded. Words recur, so that each Python worker keeps a bounded memory of words, by a 64-bit hash, and
their ids (some 40 megabytes at most, and those of the batch in work). Texts of ASCII and letters up to U+00FF are cut into words by their bytes, all others by the pattern.

Results for odd input: a null or empty text has no ids, and decodes to an empty text; repeated rows come as often as they
are; a null ``doc_id`` is passed on; an empty table gives no rows. A text is encoded whole in one task, in time that is
linear in it (and a logarithm for a word over ``LONG_WORD``), and takes some 60 bytes of memory for each of its own.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, empty_safe, gather, pieces, tokenizer_file, word_hashes

#: Words whose ids a Python worker remembers, at most, and ids after which it forgets them.
MEMORY, MEMORY_IDS = 500_000, 1 << 22
#: Words of more bytes are merged by a heap.
LONG_WORD = 64
NO_RANK = 1 << 60


def printable_bytes() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Merges:
    """Which pairs of ids merge, in which order, and the ids of single bytes inside and at the end of a word."""

    def __init__(self, merges: dict[int, tuple[int, int]], made: np.ndarray, inner: np.ndarray, last: np.ndarray):
        #: (left id, right id) as one number: (rank, id of both together); ``made`` has the latter by rank.
        self.merges, self.pair_made, self.inner, self.last = merges, made, inner, last
        order = sorted(merges)
        self.pair_keys = np.array(order, np.int64)
        self.pair_ranks = np.array([merges[k][0] for k in order], np.int64)

    def merge_words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words ``data[start : start + length]``, one after another, and how many each has."""
        counts = np.zeros(len(starts), np.int64)
        order = np.argsort(lengths, kind="stable")
        short = order[lengths[order] <= LONG_WORD]
        chunks = []
        for at in range(0, len(short), 8192):
            some = short[at : at + 8192]
            width = int(lengths[some].max())
            inside = np.arange(width) < lengths[some][:, None]
            parts = np.full((len(some), width + 1), -1, np.int64)
            parts[:, :-1][inside] = self.inner[data[(starts[some][:, None] + np.arange(width))[inside]]]
            rows = np.arange(len(some))
            parts[rows, lengths[some] - 1] = self.last[data[starts[some] + lengths[some] - 1]]
            sizes = self._merge_short(parts, lengths[some].copy())
            counts[some] = sizes
            chunks.append(parts[np.arange(width + 1) < sizes[:, None]])
        for i in order[len(short) :].tolist():
            word = data[starts[i] : starts[i] + lengths[i]]
            chunks.append(np.array(self._merge_long([*self.inner[word[:-1]].tolist(), int(self.last[word[-1]])]), np.int64))
            counts[i] = len(chunks[-1])
        # Back to the order of the words.
        begin = np.empty(len(starts), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return gather(np.concatenate(chunks) if chunks else np.empty(0, np.int64), begin, counts).astype(np.uint32), counts

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in ``pair_keys``' order of ranks; NO_RANK for pairs that do not merge."""
        keys = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], NO_RANK)

    def _merge_short(self, parts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Merges the rows of ``parts`` (-1 beyond a word's end) in place, and returns how many parts each keeps.

        A step deletes one boundary in every row that has a pair with a rank.
        """
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        rows = np.arange(len(parts))
        columns = np.arange(parts.shape[1] - 1)
        while True:
            at = ranks[rows].argmin(axis=1)  # the leftmost of equal ranks
            least = ranks[rows, at]
            live = least < NO_RANK
            rows, at, least = rows[live], at[live], least[live]
            if not len(rows):
                return sizes
            p, r, i = parts[rows], ranks[rows], np.arange(len(rows))
            p[i, at] = self.pair_made[least]
            beyond = columns > at[:, None]
            p[:, :-1] = np.where(beyond, p[:, 1:], p[:, :-1])
            p[:, -1] = -1
            r[:, :-1] = np.where(beyond[:, :-1], r[:, 1:], r[:, :-1])
            r[:, -1] = NO_RANK
            r[i, at] = self._ranks(p[i, at], p[i, at + 1])
            before = np.maximum(at - 1, 0)
            r[i, before] = np.where(at > 0, self._ranks(p[i, before], p[i, at]), r[i, before])
            parts[rows], ranks[rows] = p, r
            sizes[rows] -= 1

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        left, right = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(m[0], i, a, b, m[1]) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (m := merges.get(a << 32 | b))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, both = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = both, -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q < n and (m := merges.get(ids[p] << 32 | ids[q])):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q], m[1]))
        return [i for i in ids if i >= 0]


class Vocabulary(Merges):
    """Ids, merge ranks and special strings of a tokenizer's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        made = np.array([m for _, m in sorted(merges.values())], np.int64)
        chars = printable_bytes()
        super().__init__(merges, made, np.array([vocab[c] for c in chars], np.int64), np.array([vocab[c + self.end] for c in chars], np.int64))
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.tokens = {i: t for t, i in {**vocab, **self.special}.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None


@lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(tokenizer_file(name))


#: Characters that neither compose with nor move past a neighbour in any version of Unicode, and are lowered one by one.
_SAFE = re.compile("[\0-\u02ff\u0400-\u0482\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fff\uac00-\ud7a3]*")


def normal(text: str) -> str:
    """NFC and lower case: by Python where no character has a part in compositions, else by the tokenizers library's tables.

    Versions of Unicode differ in which marks there are and how they are ordered, so that Python's tables would not do.
    """
    if _SAFE.fullmatch(text):
        return text.lower()
    from tokenizers import normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)


@lru_cache(maxsize=1)
def word_pattern() -> str:
    """The tokenizer's pattern with the classes of letters and numbers spelled out, as Python's ``re`` lacks them.

    The classes are asked of the tokenizers library's own tables, as Unicode versions differ in them; planes from 4 on
    have none. Made once, on the driver; tasks get the text of the pattern.
    """
    from tokenizers import Regex, pre_tokenizers

    every = [*range(0xD800), *range(0xE000, 0x40000)]

    def ranges(kind: str) -> str:
        split = pre_tokenizers.Split(Regex(f"\\p{{{kind}}}+"), "removed", invert=True)
        blocks = ("".join(map(chr, every[i : i + 4096])) for i in range(0, len(every), 4096))
        return "".join(f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}" for block in blocks for run, _ in split.pre_tokenize_str(block))

    letters, numbers = ranges("L"), ranges("N")
    space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+"


#: Kinds of bytes: 0 neither letter nor digit nor space, 1 white space, 2 digit, 3 letter.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 3
_KIND[128:192] = _KIND[0xC3] = 3  # U+00C0 to U+00FF, two bytes each, but for two signs that plain() excludes
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NOT_PLAIN = re.compile(rb"[\x80-\xc2\xc4-\xff](?<![\xc3][\x80-\x96\x98-\xb6\xb8-\xbf])|<\|")


def plain(text: bytes) -> bool:
    """Whether a text holds ASCII and letters up to U+00FF only, and no special string: then bytes tell its words."""
    return text.isascii() and b"<|" not in text or not _NOT_PLAIN.search(text)


def plain_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of plain texts: lower-case bytes, where words start, their lengths, and the text of each."""
    sizes = np.array([len(t) for t in texts])
    data = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    n = len(data)
    if not n:
        return data, *(np.empty(0, np.int64) for _ in range(3))
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    data[after[(data[after] < 0x9F)]] += 0x20
    kind = _KIND[data]
    begins = np.empty(n, bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == 2
    edges = np.cumsum(sizes)[:-1]
    begins[edges[edges < n]] = True
    # An apostrophe alone takes the letters of a contraction with it.
    quote = np.flatnonzero((data == 0x27) & begins)
    quote = quote[quote + 1 < n]
    quote = quote[begins[quote + 1] & (kind[quote + 1] == 3) & ~np.isin(quote + 1, edges)]
    for i in quote.tolist():
        short = data[i + 1] in b"stmd"
        if short or (i + 2 < n and not begins[i + 2] and bytes(data[i + 1 : i + 3]) in (b"re", b"ve", b"ll")):
            begins[i + 1] = False
            if (stop := i + 2 + (not short)) < n:
                begins[stop] = True
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.append(starts, n))
    of = np.repeat(np.arange(len(texts)), sizes)[starts]
    words = kind[starts] != 1
    return data, starts[words], lengths[words], of[words]


class WordMemory:
    """The ids of words, of which a bounded number are remembered by a 64-bit hash.

    Hashes lie in sorted runs; a new run is merged with the last while that is not twice as long, so that adding words
    costs a logarithm and never a copy of all. Ids lie in one array that grows by a quarter as it fills.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self._forget()

    def _forget(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # hashes, where the ids begin, how many
        self.ids, self.used = np.empty(1 << 12, np.uint32), 0

    def _find(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of known words begin, else -1, and how many they are."""
        begin, count = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        for hashes, b, c in self.runs:
            at = np.minimum(np.searchsorted(hashes, distinct), len(hashes) - 1)
            hit = hashes[at] == distinct
            begin[hit], count[hit] = b[at[hit]], c[at[hit]]
        return begin, count

    def _add(self, hashes: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        run = (hashes, self.used + np.cumsum(count) - count, count)
        while self.runs and len(self.runs[-1][0]) < 2 * len(run[0]):
            both = [np.concatenate(pair) for pair in zip(self.runs.pop(), run, strict=True)]
            order = np.argsort(both[0], kind="stable")
            run = tuple(x[order] for x in both)
        self.runs.append(run)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used // 4 + len(ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each has."""
        distinct, sample, inverse = np.unique(word_hashes(data, starts, lengths), return_index=True, return_inverse=True)
        if sum(len(r[0]) for r in self.runs) + len(distinct) > MEMORY or self.used > MEMORY_IDS:
            self._forget()
        begin, count = self._find(distinct)
        new = begin < 0
        if new.any():
            ids, made = self.merges.merge_words(data, starts[sample[new]], lengths[sample[new]])
            begin[new], count[new] = self.used + np.cumsum(made) - made, made
            self._add(distinct[new], ids, made)
        count = count[inverse]
        return gather(self.ids, begin[inverse], count), count


class WordEncoder:
    """Encodes texts, with a memory of words."""

    def __init__(self, name: str, pattern: str):
        self.vocabulary = vocabulary(name)
        self.pattern = re.compile(pattern)
        self._words = WordMemory(self.vocabulary).words

    def _others(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts of any kind; the words of all go through the memory at once."""
        special, words = self.vocabulary.split, []
        runs: list[list] = []  # of each text: special ids, and (first word, last word) of what lies between
        for text in texts:
            runs.append([])
            for part in special.split(text) if special else [text]:
                if part in self.vocabulary.special:
                    runs[-1].append(np.array([self.vocabulary.special[part]], np.uint32))
                else:
                    first = len(words)
                    words += [w.encode() for w in self.pattern.findall(normal(part))]
                    runs[-1].append((first, len(words)))
        lengths = np.array([len(w) for w in words], np.int64)
        ids, count = self._words(np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths) if words else (np.empty(0, np.uint32), lengths)
        at = np.append(0, np.cumsum(count))
        return [np.concatenate([r if isinstance(r, np.ndarray) else ids[at[r[0]] : at[r[1]]] for r in runs_]) for runs_ in runs]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text."""
        by_bytes = [plain(t) for t in texts]
        chosen = [t for t, p in zip(texts, by_bytes, strict=True) if p]
        data, starts, lengths, of = plain_words(chosen)
        ids, count = self._words(data, starts, lengths)
        ends = np.cumsum(np.bincount(of, weights=count, minlength=len(chosen))).astype(np.int64).tolist()
        found = (ids[a:b] for a, b in zip([0, *ends], ends, strict=False))
        others = iter(self._others([t.decode() for t, p in zip(texts, by_bytes, strict=True) if not p]))
        return [next(found if p else others) for p in by_bytes]


@lru_cache(maxsize=2)
def encoder(name: str, pattern: str) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(name, pattern)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    pattern = word_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, pattern)
        for batch, texts in pieces(batches, "text"):
            ids = own.encode(texts)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = pa.array(np.concatenate(ids).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], schema=schema)

    return empty_safe(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``ids``: the tokens joined by a space, special ones kept."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(tokenizer).tokens.get
        for batch in batches:
            texts = [" ".join([t for i in ids if (t := token(i)) is not None]) for ids in (x or [] for x in batch.column(1).to_pylist())]
            yield batch_of(schema, [batch.column(0).to_pylist(), texts])

    return empty_safe(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """For each document the number of its ids, a digest of them, and one of the text they decode to.

    Encodes and decodes in one pass, without holding more than a few megabytes of texts at once.
    """

    pattern = word_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, pattern)
        known = own.vocabulary.tokens
        tokens = [known.get(i, "") for i in range(max(known) + 1)]
        decimal = [*map(str, range(len(tokens)))]
        for batch, texts in pieces(batches, "text"):
            rows: tuple[list, list, list] = ([], [], [])
            for ids in own.encode(texts):
                numbers = ids.tolist()
                rows[0].append(len(numbers))
                rows[1].append(hashlib.sha256(" ".join(map(decimal.__getitem__, numbers)).encode()).hexdigest())
                rows[2].append(hashlib.sha256(" ".join(map(tokens.__getitem__, numbers)).encode()).hexdigest())
            yield batch_of(SCHEMA, [batch.column(0).to_pylist(), *rows])

    return empty_safe(docs, "doc_id", "text").mapInArrow(run, DDL)


