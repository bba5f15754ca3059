"""Byte-level byte-pair encoding by a global shuffle of distinct words, and decoding.

Texts are cut into pre-tokens by a pattern, and runs of texts (pieces, of about ``PIECE_BYTES``) number their distinct
words. Each distinct word of a piece is sent once, by a hash of the word, to a bucket, where words from everywhere meet and
each is encoded once by the ranks of a vocabulary. Its ids go back to the pieces that asked. The positions (the number of the
word at each place of each text) go straight to where a piece is put together again, and are never grouped by word, so that a
frequent word costs one row of a bucket for each piece, however often it occurs. Decoding joins ids with the table of the bytes of tokens, which
is bounded by the vocabulary, where the ids are.

The rows of ``docs`` are cut into words twice, once for the words and once for the positions; both have to see the same
pieces. A table or a checkpoint gives the same partitions each time. A piece is named by a hash of its rows, and a
piece whose words did not come, as the input had changed in between, ends the job with an error; nothing is lost silently.

Results for odd input: a null or empty text has no ids and decodes to an empty text; a null ``doc_id`` is passed on; repeated
rows come as often as they are; extra columns, whatever their names, are left out; an empty table gives no rows. A text of
any length lies in one piece, so that a task holds it, and some 30 bytes for each of its words. Inside one piece words are
told apart by 64-bit hashes (for a million words, two are taken for one with a chance of 1 in 30 million).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame

from .bpe import Merges, WordMemory
from .common import batch_of, bounded, empty_safe, gather, pieces, shuffle_width, tokenizer_file, word_hashes

#: Bytes of texts whose distinct words are numbered together.
PIECE_BYTES = 32 << 20
#: Buckets that words are dealt to, at most; fewer where the session shuffles to fewer partitions.
BUCKETS = 8192
#: Packed rows that a bucket encodes together.
BUCKET_BYTES = 8 << 20
#: White space of the pattern (fixed values); Python's ``re`` takes four separators more for it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class RankMerges(Merges):
    """The merges of a file of ranks: two tokens merge if their bytes together are a token, the smallest rank first."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        merges = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    merges[left << 32 | right] = (rank, rank)
        single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        super().__init__(merges, np.arange(max(self.ranks.values()) + 1, dtype=np.int64), single, single)
        #: The token-byte table: the bytes of all tokens, and where each one's begin and how many they are.
        order = sorted(self.ranks.items(), key=lambda x: x[1])
        self.bytes = np.frombuffer(b"".join(t for t, _ in order), np.uint8)
        self.count = np.zeros(order[-1][1] + 1, np.int64)
        self.count[[r for _, r in order]] = [len(t) for t, _ in order]
        self.begin = np.cumsum(self.count) - self.count

    def merge_words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As the base, but a word that is a token is that token, whether merges lead to it or not."""
        ids, counts = super().merge_words(data, starts, lengths)
        whole = np.full(len(starts), -1, np.int64)
        for i in np.flatnonzero(counts > 1).tolist():
            if lengths[i] <= 256:
                whole[i] = self.ranks.get(data[starts[i] : starts[i] + lengths[i]].tobytes(), -1)
        if (whole < 0).all():
            return ids, counts
        begin = np.cumsum(counts) - counts
        ids[begin[whole >= 0]] = whole[whole >= 0]
        kept = np.where(whole >= 0, 1, counts)
        return gather(ids, begin, kept), kept

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens, one after another."""
        ids = ids.astype(np.int64)
        return gather(self.bytes, self.begin[ids], self.count[ids]).tobytes()


@lru_cache(maxsize=2)
def rank_merges(name: str) -> RankMerges:
    """One for each Python worker."""
    return RankMerges(tokenizer_file(name))


@lru_cache(maxsize=2)
def classes(pattern: str) -> tuple[str, str]:
    """The pattern with exact classes of letters and numbers, and one for the characters on which tables differ.

    The classes are asked of the tiktoken library's own tables, as versions of Unicode differ in them. Made once, on the driver.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    known, differ = {r"\s": SPACE}, set()
    for name in (r"\p{L}", r"\p{N}"):
        ask = tiktoken.Encoding(name, pat_str=f"{name}+", mergeable_ranks=single, special_tokens={})
        there = ask.decode_bytes(ask.encode_ordinary(every)).decode()
        differ |= set(there) ^ set(regex.findall(name, every))
        known[name] = _ranges(there)
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern):
        inside = part == "[" or inside and part != "]"
        bare = known.get(part, f"^{SPACE}" if part == r"\S" else "")
        out.append(part if not bare else bare if inside else f"[{bare}]")
    return "".join(out), _ranges("".join(sorted(differ)))


def _ranges(text: str) -> str:
    """A class of ascending characters."""
    out: list[list[int]] = []
    for c in map(ord, text):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


#: Kinds of bytes: 0 neither letter nor digit nor space, 1 white space, 2 digit, 3 letter.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 3
_KIND[128:192] = _KIND[0xC3] = 3  # U+00C0 to U+00FF, two bytes each, but for two signs that plain() excludes
_NOT_PLAIN = re.compile(rb"[\x80-\xc2\xc4-\xff](?<![\xc3][\x80-\x96\x98-\xb6\xb8-\xbf])")


def plain(text: bytes) -> bool:
    """Whether a text holds ASCII and letters up to U+00FF only, so that its bytes tell its words."""
    return text.isascii() or not _NOT_PLAIN.search(text)


def plain_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of plain texts: all bytes, where pre-tokens start, their lengths, and how many each text has.

    The pattern by bytes: runs of one kind; the last white space before another kind is a word by itself, or, if a space, goes
    with the run after it; an apostrophe alone takes the letters of a contraction.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if not n:
        return data, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    kind = _KIND[data]
    edge = np.zeros(n + 1, bool)
    edge[np.cumsum(sizes)] = edge[0] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    begins = change | edge[:-1]
    # The last white space of a run, where another kind follows in the same text.
    last = np.flatnonzero((kind[:-1] == 1) & change[1:] & ~edge[1:-1])
    begins[last] = True
    begins[last[data[last] == 0x20] + 1] = False
    quote = np.flatnonzero((data == 0x27) & begins)
    quote = quote[quote + 1 < n]
    quote = quote[begins[quote + 1] & (kind[quote + 1] == 3) & ~edge[quote + 1]]
    for i in quote.tolist():
        short = data[i + 1] in b"stmd"
        if short or (i + 2 < n and not begins[i + 2] and bytes(data[i + 1 : i + 3]) in (b"re", b"ve", b"ll")):
            begins[i + 1] = False
            if (stop := i + 2 + (not short)) < n:
                begins[stop] |= kind[stop] == 3
    starts = np.flatnonzero(begins)
    return data, starts, np.diff(np.append(starts, n)), np.bincount(np.repeat(np.arange(len(texts)), sizes)[starts], minlength=len(texts))


class Splitter:
    """Cuts texts into pre-tokens."""

    def __init__(self, pattern: str, exact: str, differ: str):
        self.pattern, self.differ = regex.compile(pattern), regex.compile(f"[{differ}]") if differ else None
        self.exact = exact

    def _find(self, text: str) -> list[str]:
        if self.differ and self.differ.search(text):
            return re.findall(self.exact, text)
        return self.pattern.findall(text)

    def split(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, where pre-tokens start in them, their lengths, and how many each text has; texts in their order."""
        by_bytes = [plain(t) for t in texts]
        data, starts, lengths, counts = plain_words([t for t, p in zip(texts, by_bytes, strict=True) if p])
        if all(by_bytes):
            return data, starts, lengths, counts
        found = [[w.encode() for w in self._find(t.decode())] for t, p in zip(texts, by_bytes, strict=True) if not p]
        sizes = np.array([len(w) for words in found for w in words], np.int64)
        all_starts = np.concatenate([starts, len(data) + np.cumsum(sizes) - sizes])
        all_lengths = np.concatenate([lengths, sizes])
        data = np.concatenate([data, np.frombuffer(b"".join(w for words in found for w in words), np.uint8)])
        # Back to the order of the texts.
        is_plain = np.array(by_bytes)
        number = np.empty(len(texts), np.int64)
        number[is_plain], number[~is_plain] = counts, [len(words) for words in found]
        begin = np.empty(len(texts), np.int64)
        begin[is_plain] = np.cumsum(number[is_plain]) - number[is_plain]
        begin[~is_plain] = len(starts) + np.cumsum(number[~is_plain]) - number[~is_plain]
        order = gather(np.arange(len(all_starts)), begin, number)
        return data, all_starts[order], all_lengths[order], number


@lru_cache(maxsize=2)
def splitter(pattern: str, exact: str, differ: str) -> Splitter:
    """One for each Python worker."""
    return Splitter(pattern, exact, differ)


class Piece:
    """Texts whose distinct words are numbered together."""

    def __init__(self):
        self.name, self.size = xxhash.xxh3_64(), 0
        self.doc_ids: list[int | None] = []
        self.counts: list[np.ndarray] = []
        self.chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # distinct hashes, their bytes, lengths, and the place of each word among them

    def add(self, doc_ids: list[int | None], texts: list[bytes], own: Splitter, positions: bool) -> None:
        data, starts, lengths, counts = own.split(texts)
        hashes, sample, inverse = np.unique(word_hashes(data, starts, lengths), return_index=True, return_inverse=True)
        sizes = lengths[sample]
        self.chunks.append((hashes, np.empty(0, np.uint8) if positions else gather(data, starts[sample], sizes), sizes, inverse if positions else np.empty(0, np.int64)))
        self.doc_ids += doc_ids
        self.counts.append(counts)
        self.size += sum(map(len, texts))
        self.name.update(repr(doc_ids).encode())
        for text in texts:
            self.name.update(text)
            self.name.update(b"\xff")  # no byte of a text

    def key(self) -> int:
        """The piece's name: a number that only the same texts have again."""
        return self.name.intdigest() >> 1

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """The first of each distinct word among those of all chunks, and the number (by hash) of each of those."""
        _, first, number = np.unique(np.concatenate([c[0] for c in self.chunks]), return_index=True, return_inverse=True)
        return first, number


def _pieces(batches: Iterator[pa.RecordBatch], own: Splitter, positions: bool) -> Iterator[Piece]:
    piece = Piece()
    for batch, texts in pieces(batches, "text"):
        if piece.doc_ids and piece.size + sum(map(len, texts)) > PIECE_BYTES:
            yield piece
            piece = Piece()
        piece.add(batch.column(0).to_pylist(), texts, own, positions)
    if piece.doc_ids:
        yield piece


WORDS = pa.schema([("bucket", pa.int32()), ("piece", pa.int64()), ("numbers", pa.binary()), ("lengths", pa.binary()), ("bytes", pa.binary())])
ANSWERS = pa.schema([("piece", pa.int64()), ("kind", pa.int32()), ("numbers", pa.binary()), ("counts", pa.binary()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])
ANSWERS_DDL = "piece long, kind int, numbers binary, counts binary, payload binary, doc_ids array<long>"


def _cuts(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])), len(sorted_))


def distinct_words(docs: DataFrame, split: tuple[str, str, str], buckets: int) -> DataFrame:
    """The distinct words of each piece, packed in a row for each bucket that they are dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, splitter(*split), False):
            first, _ = piece.numbered()
            if not len(first):
                continue
            hashes, data, sizes = (np.concatenate([c[i] for c in piece.chunks]) for i in range(3))
            begin = np.cumsum(sizes) - sizes
            of = (hashes[first] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            key, cuts, at = piece.key(), _cuts(of[order]), first[order]
            for a, b in zip(cuts, cuts[1:], strict=False):
                some = at[a:b]
                yield batch_of(WORDS, [[int(of[order[a]])], [key], [order[a:b].astype("<u4").tobytes()], [sizes[some].astype("<u4").tobytes()], [gather(data, begin[some], sizes[some]).tobytes()]])

    return docs.mapInArrow(run, "bucket int, piece long, numbers binary, lengths binary, bytes binary")


def encode_words(words: DataFrame, ranks: str) -> DataFrame:
    """The ids of the words of each packed row; in a bucket each distinct word is encoded once, as long as it is remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, bucket = WordMemory(rank_merges(ranks)), None
        for held in bounded((b.slice(i, 1) for b in batches for i in range(b.num_rows)), BUCKET_BYTES):
            rows = [[b.column(c)[0].as_py() for b in held] for c in range(5)]
            if rows[0][0] != bucket:  # words of another bucket are others
                memory, bucket = WordMemory(rank_merges(ranks)), rows[0][-1]
            sizes = [np.frombuffer(x, "<u4").astype(np.int64) for x in rows[3]]
            lengths = np.concatenate(sizes)
            ids, counts = memory.words(np.frombuffer(b"".join(rows[4]), np.uint8), np.cumsum(lengths) - lengths, lengths)
            stop = np.cumsum([len(s) for s in sizes])
            at = np.append(0, np.cumsum(counts))
            out = [[], []]
            for a, b in zip([0, *stop], stop, strict=False):
                out[0].append(counts[a:b].astype("<u4").tobytes())
                out[1].append(ids[at[a] : at[b]].astype("<u4").tobytes())
            yield batch_of(ANSWERS, [rows[1], [0] * len(held), rows[2], *out, [None] * len(held)])

    return words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, ANSWERS_DDL)


def word_positions(docs: DataFrame, split: tuple[str, str, str]) -> DataFrame:
    """A row for each piece: its documents, and the number of the word at each of their places, in planes of one byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=1).compress
        for piece in _pieces(batches, splitter(*split), True):
            first, number = piece.numbered()
            stop = np.cumsum([len(c[0]) for c in piece.chunks])
            places = np.concatenate([number[a:b][c[3]] for a, b, c in zip([0, *stop], stop, piece.chunks, strict=False)]).astype("<u4")
            # By how often a word occurs, frequent ones first, which takes least room.
            often = np.bincount(places, minlength=len(first))
            order = np.argsort(-often, kind="stable").astype("<u4")
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order), dtype="<u4")
            planes = np.ascontiguousarray(rank[places].view(np.uint8).reshape(-1, 4).T)
            counts = np.concatenate(piece.counts).astype("<u4")
            yield batch_of(ANSWERS, [[piece.key()], [1], [shrink(order.tobytes())], [counts.tobytes()], [shrink(planes.tobytes())], [piece.doc_ids]])

    return docs.mapInArrow(run, ANSWERS_DDL)


Finish = Callable[[list, list[np.ndarray]], pa.RecordBatch]


def _assembled(docs: DataFrame, ranks: str, pattern: str, finish: Finish, ddl: str) -> DataFrame:
    """``finish`` of the documents and ids of some texts at a time, put together from positions and encoded words."""
    own = empty_safe(docs, "doc_id", "text")
    exact, differ = classes(pattern)
    split = (pattern, exact, differ)
    buckets = max(1, min(BUCKETS, shuffle_width(docs.sparkSession)))
    answers = encode_words(distinct_words(own, split, buckets), ranks).unionByName(word_positions(own, split))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor().decompress
        at, held = None, []
        for row in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):  # of equal pieces, all words and then all positions
            piece, kind, numbers, counts, payload, doc_ids = (c[0].as_py() for c in row.columns)
            if piece != at:
                at, held = piece, []
            if kind == 0:  # the words of a piece come before its positions
                held.append((numbers, counts, payload))
                continue
            order = np.frombuffer(grow(numbers), "<u4")
            word, many, ids = (np.frombuffer(b"".join(h[i] for h in held), "<u4") for i in range(3))
            planes = np.frombuffer(grow(payload), np.uint8).reshape(4, -1)
            places = order[np.ascontiguousarray(planes.T).view("<u4").ravel()] if planes.size else np.empty(0, "<u4")
            known = np.full(len(order), -1, np.int64)
            if (word < len(order)).all():
                known[word] = np.arange(len(word))
            if (known < 0).any():
                raise RuntimeError("the input gave other partitions when it was read again: write it to a table or checkpoint first")
            begin = np.cumsum(many, dtype=np.int64) - many
            stop = np.append(0, np.cumsum(np.frombuffer(counts, "<u4").astype(np.int64)))
            for first in range(0, len(doc_ids), 1024):
                some = range(first, min(first + 1024, len(doc_ids)))
                each = [known[places[stop[i] : stop[i + 1]]] for i in some]
                yield finish([doc_ids[i] for i in some], [gather(ids, begin[w], many[w].astype(np.int64)) for w in each])

    return answers.repartition("piece").sortWithinPartitions("piece", "kind").mapInArrow(run, ddl)


def encode_texts(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def finish(doc_ids: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32)))], schema=schema)

    return _assembled(docs, ranks, pattern, finish, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks: str) -> DataFrame:
    """``doc_id`` and ``bytes`` of rows with ``ids``, by a join with the token-byte table; null ids decode to nothing."""
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rank_merges(ranks)
        for batch in batches:
            yield batch_of(schema, [batch.column(0).to_pylist(), [table.decode(np.array([i for i in x or [] if i is not None], np.int64)) for x in batch.column(1).to_pylist()]])

    return empty_safe(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digest_texts(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """For each document the number of its ids, a digest of them, and one of the bytes they decode to."""

    def finish(doc_ids: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        table = rank_merges(ranks)
        digests = [(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(table.decode(x)).hexdigest()) for x in ids]
        return batch_of(DIGEST, [doc_ids, [len(x) for x in ids], [a for a, _ in digests], [b for _, b in digests]])

    return _assembled(docs, ranks, pattern, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
