"""Encoding, licences, chat formatting, packing and the quality classifier."""

import hashlib
import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codestrata.llm import bpe, chat, licenses, packing, quality, queries

from .helpers import corpus, documents, lower

ODD = [
    None, "", " ", "it's I'LL we'd'VE 'so ''s a's", "İstanbul ΑΣ Σ", "e\u0301 a\u0300\u0301 \u00a0x", "a" * 300 + " " + "é" * 100, "É×È÷ß ÀÿŸ",
    "<|endoftext|> a<|startoftext|>b <|endo", "漢字 한국어 ١٢٣ ½²", "x" * 5000, "123 4.5 _a_", "a\x1cb\x85c", "tab\tnew\nline",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_and_decoding_equal_the_library(spark, library):
    texts = ODD + corpus()
    ids = {r.doc_id: r.ids for r in bpe.encode_texts(documents(spark, texts), queries.TOKENIZER).collect()}
    encoded = bpe.encode_texts(documents(spark, texts), queries.TOKENIZER)
    back = {r.doc_id: r.text for r in bpe.decode_ids(encoded, queries.TOKENIZER).collect()}
    rows = {r.doc_id: r for r in bpe.digest_texts(documents(spark, texts), queries.TOKENIZER).collect()}
    for i, text in enumerate(texts):
        expected = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(expected, skip_special_tokens=False)
        assert ids[i] == expected, text
        assert back[i] == decoded
        assert rows[i].n_tokens == len(expected)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_ids_of_given_documents(spark, sf_dir, library):
    docs = queries.read_table(spark, sf_dir, "documents")
    expected = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}
    assert {r.doc_id: r.ids for r in bpe.encode_texts(docs, queries.TOKENIZER).collect()} == expected


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=60))
def test_any_latin_text_equals_the_library(library, text):
    assert bpe.encoder(queries.TOKENIZER, bpe.word_pattern()).encode([text.encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_code_point_is_classed_and_lowered_as_by_the_library(library):
    own = bpe.encoder(queries.TOKENIZER, bpe.word_pattern())
    points = [c for c in [*range(0x40000), *range(0xDFFF0, 0xE0400), *range(0x10FF00, 0x110000)] if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 2048):
        text = "".join(f"a{chr(c)}1 {chr(c)}\u0307" for c in points[at : at + 2048])
        assert own.encode([text.encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids, hex(points[at])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text_equals_the_library(library, text):
    assert bpe.encoder(queries.TOKENIZER, bpe.word_pattern()).encode([text.encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def marks():
    """Combining marks of this Python's Unicode, and code points right after one that later versions may have given to more."""
    mark = [unicodedata.category(chr(c))[0] == "M" for c in range(0x1E960)]
    return [chr(c) for c in range(0x300, 0x1E960) if mark[c] or any(mark[c - 4 : c]) and unicodedata.category(chr(c)) == "Cn"]


def test_pairs_of_marks_are_ordered_as_by_the_library(library):
    own = bpe.encoder(queries.TOKENIZER, bpe.word_pattern())
    every = marks()
    few = [*{unicodedata.combining(m): m for m in every}.values(), "\u0345", "\u0316", "\u0301"]
    texts = [" ".join(f"a{m}{n} e{n}{m}" for m in every) for n in few]
    for text, found in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert found.tolist() == library.encode(text, add_special_tokens=False).ids


def test_random_strings_with_marks_equal_the_library(library):
    own, rng, every = bpe.encoder(queries.TOKENIZER, bpe.word_pattern()), random.Random(9), marks()
    letters = [*"aeiouyAEn oO1'.", "\u03a3", "\u1100", "\u1161", "\u11a8", "\uac00", "\u304b", "\u3099", "\u0915", "\u093c", "\u2126", "\u212b", "\u0130"]
    texts = ["".join(rng.choice(letters) if rng.random() < 0.5 else rng.choice(every) for _ in range(rng.randint(1, 12))) for _ in range(100_000)]
    for at in range(0, len(texts), 5000):
        some = texts[at : at + 5000]
        expected = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        assert [x.tolist() for x in own.encode([t.encode() for t in some])] == expected


def test_safe_characters_stay_as_they_are_beside_each_other(library):
    safe = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if bpe._SAFE.fullmatch(c)]
    rng = random.Random(4)
    text = "".join(rng.choice(safe) for _ in range(100_000))
    from tokenizers import normalizers

    assert normalizers.NFC().normalize_str(text) == text
    assert normalizers.Lowercase().normalize_str(text) == text.lower()


def test_heap_and_scan_merge_alike():
    v = bpe.vocabulary(queries.TOKENIZER)
    rng = random.Random(2)
    for _ in range(200):
        word = bytes(rng.choice(b"abcdeinorst") for _ in range(rng.randint(1, 60)))
        ids, _ = v.merge_words(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))
        assert ids.tolist() == v._merge_long([*v.inner[list(word[:-1])].tolist(), int(v.last[word[-1]])])


def test_forgetting_words_changes_nothing(monkeypatch):
    texts = [(t or "").encode() for t in corpus(3)]
    expected = [x.tolist() for x in bpe.WordEncoder(queries.TOKENIZER, bpe.word_pattern()).encode(texts)]
    monkeypatch.setattr(bpe, "MEMORY", 10)
    own = bpe.WordEncoder(queries.TOKENIZER, bpe.word_pattern())
    assert [own.encode([t])[0].tolist() for t in texts] == expected


LICENCE_TEXTS = [
    None, "", "Licensed under CC BY-NC 4.0.", "GNU General Public License, version 3", "All rights reserved. ALL RIGHTS RESERVED all rights\treserved",
    "cc by cc by cc", "SPDX-License-Identifier: MIT OR (GPL-2.0-only WITH Classpath-exception-2.0 AND Apache-2.0)\nrest", "SPDX-License-Identifier: (MIT OR",
    "ccby cc bye ccé by", "SPDX-License-Identifier:", "x" * 20000 + " all rights reserved",
]


def test_license_places_equal_brute_force(spark):
    texts = LICENCE_TEXTS + corpus()
    rows = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            p = phrase.split()
            for k in range(len(words) - len(p) + 1):
                if words[k : k + len(p)] == p:
                    places.append(k)
                    labels.add(label)
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None)), text
        assert r.base_labels == ",".join(sorted(labels))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_expressions():
    assert licenses.postfix("mit or apache-2.0 and bsd-3-clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert licenses.postfix("(mit or apache-2.0) and gpl-2.0 with classpath") == ["mit", "apache-2.0", "or", "gpl-2.0", "classpath", "with", "and"]
    for bad in ("", "(mit", "mit)", "or mit", "mit and", "()"):
        assert licenses.postfix(bad) is None
    assert licenses.openness(licenses.postfix("mit or gpl-3.0")) == 0.9
    assert licenses.openness(licenses.postfix("mit and gpl-3.0")) == 0.4
    assert licenses.openness(licenses.postfix("gpl-2.0 with classpath")) == pytest.approx(0.5)


def test_license_exceptions_and_tags_on_one_line():
    scan = lambda t: licenses.scan_text(t.encode(), licenses.BASE_PHRASES, licenses.MORE_PHRASES)
    assert scan("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0")[5] == "spdx-classpath-exception-2.0,spdx-gpl"
    assert scan("SPDX-License-Identifier: GPL-2.0-only WITH made-up-exception")[5] == "spdx-invalid"
    assert scan("SPDX-License-Identifier: MIT SPDX-License-Identifier: ISC\nApache-2.0")[7] == "mit; isc"
    assert licenses.scan_text(b"", licenses.BASE_PHRASES, {}) == (0, 0, None, None, "", "", 0.0, "")


def test_long_texts_take_linear_time(spark):
    started = time.monotonic()
    for piece in ("\\", "</turn>", "#", "### a: ", " </turn>\n"):
        text = piece * (1_000_000 // len(piece))
        assert [(r, t) for r, t, _, _ in chat.parse(chat.render_turn("user", text))] == [("user", text)]
    for piece in ("cc by ", "SPDX-License-Identifier: MIT ", "mit and ", "(", "SPDX-License-Identifier: MIT\n"):
        licenses.scan_text((piece * (1_000_000 // len(piece))).encode(), licenses.BASE_PHRASES, licenses.MORE_PHRASES)
    assert time.monotonic() - started < 60
    places = licenses.scan_text(b"cc by " * 100_000, licenses.BASE_PHRASES, {})
    assert places[:4] == (200_000, 100_000, 0, 199_998)


def test_empty_tables(spark):
    docs = documents(spark, ["a"]).limit(0)
    assert licenses.scan_licenses(docs).count() == 0
    assert bpe.digest_texts(docs, queries.TOKENIZER).count() == 0
    assert bpe.decode_ids(bpe.encode_texts(docs, queries.TOKENIZER), queries.TOKENIZER).count() == 0


PARTS = st.lists(st.sampled_from([*"\\#<>/ :\nAé", "### ", "</turn>", "###", " </turn>\n", "turn"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PARTS | st.text(max_size=12), PARTS), max_size=4))
def test_chat_round_trip(turns):
    rendered = "".join(chat.render_turn(r, t) for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(rendered)] == turns


def test_chat_refuses_what_is_not_in_the_grammar():
    for bad in ("text", "### user: no end", "### user: a ### b </turn>\n", "### user: a </turn> b </turn>\n"):
        with pytest.raises(chat.NotInGrammar):
            chat.parse(bad)


def test_chat_digests_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "hi", "\\### Assistant: </turn> ok", "a\\", "### x", "é" * 50])) for c in (1, 2, None, 3) for t in rng.sample(range(30), 9)]
    rows += [(9, 0, "assistant", "tie b"), (9, 0, "assistant", "tie a"), (9, None, "user", "first")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    found = {r.conv_id: r for r in chat.digest_conversations(chat.in_order(chat.render_turns(table))).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(found) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert found[c].n_turns == len(turns)
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert found[c].formatted_chars == sum(len(chat.render_turn(r, x)) for _, r, x in turns)
    assert chat.digest_conversations(chat.in_order(chat.render_turns(table.limit(0)))).count() == 0


def check_packing(rows, lengths, limit):
    """Every id once, sequences gapless and within the limit."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, total in lengths.items():
        at = 0
        for start, length in sorted(docs[doc]):
            assert start == at and length > 0
            at += length
        assert at == total
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


def test_packing_equals_library_ids(spark, library):
    texts = ODD + corpus()
    rows = packing.pack_documents(documents(spark, texts), queries.TOKENIZER, max_tokens=256, max_segments=8, max_loss=256).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    n = check_packing(rows, {i: len(x) for i, x in ids.items()}, 256)
    assert n <= 1.2 * sum(map(len, ids.values())) / 256 + len(texts) / 8
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(piece) and r.doc_tokens == len(ids[r.doc_id])
    assert packing.pack_documents(documents(spark, texts).limit(0), queries.TOKENIZER).count() == 0


def test_packing_groups_are_bounded_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    taken = []
    real = packing.pack
    monkeypatch.setattr(packing, "pack", lambda found, groups, *limits: taken.append((found.count(), groups)) or real(found, groups, *limits))
    docs = documents(spark, [" ".join(f"w{i % 7}" for i in range(400 * (k + 1))) for k in range(9)])
    lengths = {r.doc_id: r.n_tokens + 1 for r in bpe.digest_texts(docs, queries.TOKENIZER).collect()}
    for max_loss in (64, 32):  # full pieces stand alone; pieces of the loss limit's length do not fill a sequence
        rows = packing.pack_documents(docs, queries.TOKENIZER, max_tokens=64, max_segments=8, max_loss=max_loss).collect()
        check_packing(rows, lengths, 64)
        loss = defaultdict(int)
        for r in rows:
            loss[r.sequence_id] += r.loss_tokens
        assert max(loss.values()) <= max_loss
    assert taken[0][0] <= 9  # a rest for each document at most
    assert taken[1][0] > 500 and all(pieces <= 50 * groups for pieces, groups in taken)


def test_loss_bearing_tokens_bind_where_prompts_are_short(spark):
    rows = [(i, " ".join(["a"] * 29), 0 if i % 2 else 28) for i in range(60)]  # 30 tokens: 29 or 2 that bear loss
    docs = spark.createDataFrame([*rows, (60, "a", None), (61, "a b", -5)], "doc_id long, text string, prompt long")
    packed = packing.pack_documents(docs, queries.TOKENIZER, max_tokens=128, max_segments=8, max_loss=64, prompt="prompt").collect()
    check_packing(packed, {**{i: 30 for i in range(60)}, 60: 2, 61: 3}, 128)
    assert {r.doc_id: r.loss_tokens for r in packed} == {**{i: 29 if i % 2 else 2 for i in range(60)}, 60: 1, 61: 2}
    tokens, loss = defaultdict(int), defaultdict(int)
    for r in packed:
        tokens[r.sequence_id] += r.length
        loss[r.sequence_id] += r.loss_tokens
    assert max(loss.values()) <= 64 and max(tokens.values()) <= 128
    assert len(tokens) <= 17  # 30 pieces of 29 loss-bearing tokens, two in a sequence, with two others beside them
    alike = packing.pack_documents(docs, queries.TOKENIZER, max_tokens=128, max_segments=8, max_loss=64).select("sequence_id").distinct().count()
    assert alike >= 30  # without prompts the limit of loss-bearing tokens alone lets two pieces into a sequence


def test_packing_keeps_all_limits():
    rng = np.random.default_rng(1)
    sizes = np.stack([rng.integers(1, 100, 500), np.ones(500), rng.integers(0, 50, 500)], axis=1).astype(float)
    limits = np.array([128.0, 4, 60])
    sequence, turn = packing.fill(sizes, limits)
    used = np.zeros((sequence.max() + 1, 3))
    np.add.at(used, sequence, sizes)
    assert (used <= limits).all()
    assert len({*zip(sequence.tolist(), turn.tolist(), strict=True)}) == 500


def quality_tables(spark, n=300):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi") for b in ("lo", "mi", "ru", "sta", "ver")]
    rows, labels = [], []
    for i in range(n):
        junk = i % 5 == 0
        text = " ".join(w.upper() + rng.choice(["!!", "%%%", "$$$"]) if junk else w + rng.choice(["", "", "."]) for w in rng.choices(words, k=rng.randint(20, 200)))
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, int(not junk), 0))
    odd = [None, "", "  \n"]
    texts = [t for _, t in rows] + odd + [rows[1][1]]
    table = spark.createDataFrame([*labels, (None, 1, 0), (7, None, None), (2, 1, None)], "doc_id long, quality int, toxic int")
    return documents(spark, texts, [*range(n + len(odd)), 1]), table


def test_quality_keeps_good_documents(spark):
    docs, labels = quality_tables(spark)
    kept = [r.doc_id for r in quality.resample(docs, labels).collect()]
    good = [i for i in range(300) if i % 5]
    assert len(set(good) & set(kept)) >= 0.97 * len(good)
    assert len(set(range(0, 300, 5)) & set(kept)) <= 2
    assert not set(kept) & {300, 301, 302}
    assert kept.count(1) == 2  # a repeated row
    rows = quality.keep_good(docs, labels)
    assert rows.columns == docs.columns
    assert sorted(r.doc_id for r in rows.collect()) == sorted(kept)


def test_quality_weights_equal_brute_force(spark):
    docs, labels = quality_tables(spark, 60)
    sample = quality.labelled_sample(labels)
    good = {r.doc_id for r in sample.collect() if r.good and not r.held}
    model = quality.fit(docs, sample)
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    for i, text in texts:
        counts = np.bincount(quality.hashed_ngrams([text])[0], minlength=quality.BUCKETS)
        raw += counts
        target += counts * (i in good)
    expected = np.log((target + 1) / (target.sum() + quality.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality.BUCKETS))
    assert np.allclose(model.ratio, expected)


def brute_sample(docs, labels, noise, k):
    """The kept ids by plain counting, from the documents, the bounded sample of labels, and each id's noise."""
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs]
    kinds = {r.doc_id: r for r in labels}
    grams = [quality.hashed_ngrams([t])[0].tolist() for _, t in rows]
    words = [{int(h) % quality.WORD_BUCKETS for h in quality.hashed_words([t])[0]} for _, t in rows]
    raw, target = Counter(), Counter()
    having, total = {"toxic": Counter(), "good": Counter()}, Counter()
    for (i, _), g, w in zip(rows, grams, words, strict=True):
        raw.update(g)
        r = kinds.get(i)
        if r and not r.held and (r.good or r.toxic):
            kind = "good" if r.good else "toxic"
            total[kind] += 1
            having[kind].update(w)
            if r.good:
                target.update(g)
    n_raw, n_target, b = sum(raw.values()), sum(target.values()), quality.BUCKETS
    ratio = {g: math.log((target[g] + 1) / (n_target + b)) - math.log((raw[g] + 1) / (n_raw + b)) for g in raw}
    share = total["toxic"] / max(1, sum(total.values()))
    odds = {}
    for w, n in having["toxic"].items():
        if n >= quality.SEEN and total["good"]:
            odds[w] = max(0.0, math.log((n + quality.PRIOR * share) / total["toxic"]) - math.log((having["good"][w] + quality.PRIOR * (1 - share)) / total["good"]))
    mean = [sum(ratio[x] for x in g) / len(g) if g else None for g in grams]
    against = [sum(sorted((odds.get(x, 0.0) for x in w), reverse=True)[: quality.STRONGEST]) for w in words]
    held = [(m, a, kinds[i].good) for (i, _), m, a in zip(rows, mean, against, strict=True) if m is not None and i in kinds and kinds[i].held]
    good, other = sorted(m for m, _, g in held if g), [m for m, _, g in held if not g]
    balanced = max(sorted(m for m, _, _ in held), key=lambda c: sum(o < c for o in other) / len(other) - sum(x < c for x in good) / len(good))
    at = min(balanced, float(np.quantile(good, quality.LOST)))
    limit = float(np.quantile([a for _, a, g in held if g], 1 - quality.LOST_TO_WORDS, method="higher"))
    weight = [None if m is None else m - (a if a > limit else 0.0) for m, a in zip(mean, against, strict=True)]
    k = k or sum(w is not None and w >= at for w in weight)
    keys = [(w - math.log(-math.log(noise[i])) * quality.TEMPERATURE, i) for (i, _), w in zip(rows, weight, strict=True) if w is not None]
    least = sorted(keys, reverse=True)[k - 1][0]
    plain = sorted(((w, i) for (i, _), w in zip(rows, weight, strict=True) if w is not None), reverse=True)[:k]
    return sorted(i for x, i in keys if x >= least - 1e-12), sorted(i for _, i in plain)


@pytest.mark.parametrize("k", [None, 40, 150])
def test_quality_sample_equals_brute_force(spark, k):
    docs, labels = quality_tables(spark, 260)
    rng = random.Random(6)
    insulted = [(r.doc_id, f"{r.text} dolt {rng.choice(['oaf', 'lout'])}", 1, 1) for r in docs.limit(250).collect() if r.doc_id % 10 == 3]
    ids = [i for i, *_ in insulted]
    docs = docs.where(~F.col("doc_id").isin(ids)).unionByName(documents(spark, [t for _, t, *_ in insulted], ids))
    labels = labels.where(F.col("doc_id").isNotNull()).unionByName(spark.createDataFrame([(i, q, t) for i, _, q, t in insulted], labels.schema))
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(quality.SEED)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    noise = {r.doc_id: r.u for r in docs.select("doc_id", uniform.alias("u")).collect()}
    expected, plain = brute_sample(docs.select("doc_id", "text").collect(), quality.labelled_sample(labels).collect(), noise, k)
    assert sorted(r.doc_id for r in quality.resample(docs, labels, k).collect()) == expected
    assert sorted(r.doc_id for r in quality.keep_good(docs, labels, k).collect()) == expected
    if k:
        assert len(set(expected) - set(plain)) >= 0.03 * k  # the noise decides


def test_quality_without_labels_or_rows(spark):
    docs, labels = quality_tables(spark, 20)
    assert quality.resample(docs, labels.limit(0)).count() == 21
    assert quality.resample(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("k", [1, 2, 17, 50, 99, 100])
def test_largest_is_the_kth(spark, k):
    rng = random.Random(3)
    keys = [rng.choice([rng.gauss(0, 1), 0.5, -2.0]) for _ in range(100)]
    rows = spark.createDataFrame([(x,) for x in keys], "gumbel_key double")
    assert quality.largest(rows, k, bins=4) == sorted(keys, reverse=True)[k - 1]


def test_quality_drops_long_documents_with_a_few_insults(spark):
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("ba", "co", "du", "fe", "gi") for b in ("lo", "mi", "ru", "sta", "ver") for c in ("n", "s", "t", "x")]
    insults = ["dolt", "oaf", "lout", "twit"]
    rows, labels = [], []
    for i in range(500):
        text = rng.choices(words, k=rng.randint(300, 600))
        if i % 5 == 0:
            for w in rng.sample(insults, 3):
                text.insert(rng.randrange(len(text)), w)
        rows.append((i, " ".join(text)))
        if i % 2 == 0:
            labels.append((i, 1, int(i % 5 == 0)))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(spark, [t for _, t in rows])
    kept = {r.doc_id for r in quality.resample(docs, table).collect()}
    assert not kept & {*range(0, 500, 5)}
    assert len(kept) >= 0.98 * 400
    assert {r.doc_id for r in quality.keep_good(docs, table).collect()} == kept
