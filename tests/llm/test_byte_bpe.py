"""Byte-level encoding by distinct words against the tiktoken library."""

import base64
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codestrata.llm import byte_bpe, queries

from .helpers import corpus, documents

ODD = [
    None, "", " ", "  ", "\n", " \n a", "a  b", "a \nb", "a\n\n b", "it's I'LL we'd've 'so ''s 's't a's' 'x 're'rex", "\t'll", " 's", ".'s", "x" * 5000, "ab" * 3000 + " " + "é" * 100, "É×È÷ß ÀÿŸ",
    "<|endoftext|> a", "漢字 한국어 ١٢٣ ½² x²", "123 4.5 _a_", "a\x1cb\x85c\x1f \xa0d", "tab\tnew\r\nline  ", "é à", "\U00031350 \U0001E030 Ᲊa", "trailing   ", "0" * 300, "-" * 400 + "'s",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path(queries.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pattern():
    import public_tokenizers

    return public_tokenizers.PATTERN


def own():
    return byte_bpe.Splitter(pattern(), *byte_bpe.classes(pattern()))


def words(splitter, texts):
    data, starts, lengths, counts = splitter.split([t.encode() for t in texts])
    found = iter(data[a : a + n].tobytes() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True))
    return [[next(found) for _ in range(c)] for c in counts.tolist()]


def encode(library, splitter, merges, texts):
    """The ids of each text by this library's splitting and merging alone."""
    from codestrata.llm.bpe import WordMemory

    data, starts, lengths, counts = splitter.split([t.encode() for t in texts])
    ids, many = WordMemory(merges).words(data, starts, lengths)
    flat, of = iter(ids.tolist()), iter(many.tolist())
    return [[next(flat) for _ in range(sum(next(of) for _ in range(c)))] for c in counts.tolist()]


def test_ids_and_decoding_equal_the_library(spark, library):
    texts = ODD + corpus()
    docs = documents(spark, texts).repartition(3).persist()
    docs.count()
    encoded = byte_bpe.encode_texts(docs, queries.RANKS, pattern())
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode_ids(encoded, queries.RANKS).collect()}
    rows = {r.doc_id: r for r in byte_bpe.digest_texts(docs, queries.RANKS, pattern()).collect()}
    for i, text in enumerate(texts):
        expected = library.encode_ordinary(text or "")
        assert ids[i] == expected, text
        assert back[i] == (text or "").encode() == library.decode_bytes(expected)
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(expected), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in expected)).hexdigest())
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    docs.unpersist()


def test_query_over_given_documents(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in queries.read_table(spark, sf_dir, "documents").collect()}
    rows = {r.doc_id: r for r in queries.QUERIES["op11_byte_bpe"](spark, sf_dir).collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        expected = library.encode_ordinary(text)
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(expected), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in expected)).hexdigest())
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_many_small_pieces_and_forgotten_words(spark, library, monkeypatch):
    """Pieces of a few texts, repeated rows, null ids; the settings are read in tasks, so that they are tried without Spark too."""
    texts = [t for t in corpus(5) if t]
    rows = [(None if i % 7 == 0 else i % 50, t) for i, t in enumerate(texts * 3)]
    found = byte_bpe.digest_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), queries.RANKS, pattern())
    got = sorted((str(r.doc_id), r.ids_sha256) for r in found.collect())
    digest = {t: hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in library.encode_ordinary(t))).hexdigest() for t in texts}
    assert got == sorted((str(i), digest[t]) for i, t in rows)
    from codestrata.llm import bpe

    monkeypatch.setattr(bpe, "MEMORY", 10)
    assert encode(library, own(), byte_bpe.rank_merges(queries.RANKS), texts) == [library.encode_ordinary(t) for t in texts]


def test_an_empty_table(spark):
    docs = documents(spark, ["x"]).limit(0)
    assert byte_bpe.digest_texts(docs, queries.RANKS, pattern()).count() == 0
    assert byte_bpe.decode_ids(byte_bpe.encode_texts(docs, queries.RANKS, pattern()), queries.RANKS).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'stredvml.,1aé×\x1c\x85　")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text_equals_the_library(library, text):
    assert encode(library, own(), byte_bpe.rank_merges(queries.RANKS), [text, "x", text + " y"]) == [library.encode_ordinary(t) for t in (text, "x", text + " y")]


def test_random_strings_equal_the_library(library):
    rng, merges, splitter = random.Random(3), byte_bpe.rank_merges(queries.RANKS), own()
    alphabet = [*"  \n\t''stredvml.,;1 29aAéÿ×÷", "\x1c", "\x85", " ", "日", "́", "\U00031350", "²"]
    for plain_only in (True, False):
        pool = alphabet[:29] if plain_only else alphabet
        texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(20000)]
        assert encode(library, splitter, merges, texts) == [library.encode_ordinary(t) for t in texts]


def test_every_code_point_is_classed_as_by_the_library(library):
    merges, splitter = byte_bpe.rank_merges(queries.RANKS), own()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 65536):
        texts = ["".join(f"a{chr(c)}1 {chr(c)}." for c in points[k : k + 512]) for k in range(at, min(at + 65536, len(points)), 512)]
        assert encode(library, splitter, merges, texts) == [library.encode_ordinary(t) for t in texts], hex(points[at])
