"""Vector codes against plain search over all entries."""

import hashlib
import math
import random

import numpy as np
import pytest

from codestrata.llm import codes, queries


def plain_nearest(x, entries):
    d = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


def brute(rows):
    """The whole contract over (vec_id, vector, label) of one dimension that four divides, in plain Python."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = np.array([r[1] for r in kept], object)
    width = v.shape[1] // 4
    parts = [v[:, p * width : (p + 1) * width] for p in range(4)]
    books = [p[:256].copy() for p in parts]
    for _ in range(4):
        for part, book in zip(parts, books, strict=True):
            at, _ = plain_nearest(part, book)
            for e in set(at.tolist()):
                book[e] = [sum(c) // len(c) for c in part[at == e].T.tolist()]
    found = [plain_nearest(p, b) for p, b in zip(parts, books, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for row in b.tolist() for x in row).encode()).hexdigest()
    error = [sum(int(d[k]) for _, d in found) for k in range(len(kept))]
    total = {label: sum(e for e, r in zip(error, kept, strict=True) if r[2] == label) for _, _, label in kept}
    return sorted((str(r[0]), "".join(f"{a[k]:02x}" for a, _ in found), error[k], total[r[2]], digest) for k, r in enumerate(kept))


def found_rows(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


SCHEMA = "vec_id long, embedding array<float>, label int, code string, v string"


@pytest.mark.parametrize("n", [3, 700])
def test_codes_equal_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(20)], rng.choice([None, 1, 1, 1, 2])) for i in range(n)]
    rows += [(5, rows[0][1], 1)] * 3 + [(None, rows[1][1], 2), (n + 1, None, 1), (n + 2, [0.5] * 19 + [None], 1), (n + 3, [float("nan")] * 20, 1), (n + 4, [float("-inf")] * 20, 1), (n + 5, [], 1)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    assert found_rows(codes.compress(table)) == brute([r for r in rows if r[1] != []])


def test_dimensions_have_codebooks_of_their_own(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.125]) for _ in range(d)], 1) for i, d in enumerate([1, 3, 4, 10, 8] * 40)]
    found = {r.vec_id: (r.code, r.error) for r in codes.compress(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()}
    for d in (4, 8, 12):
        padded = [(i, v + [0.0] * (d - len(v)), label) for i, v, label in rows if d - 4 < len(v) <= d]
        assert padded
        assert {i: found[i] for i, _, _ in padded} == {int(i): (c, e) for i, c, e, _, _ in brute(padded)}


def test_an_empty_table_and_large_components(spark):
    assert codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(Exception, match="too large for exact"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 4, 1, "", "")], SCHEMA)).collect()


def test_walsh_functions_are_in_order_of_sign_changes():
    for n in (1, 2, 4, 16, 64):
        h = codes.walsh(n)
        assert (h.T @ h == n * np.eye(n)).all()
        assert ((h[1:] != h[:-1]).sum(axis=0) == np.arange(n)).all()


@pytest.mark.parametrize("width", [1, 2, 3, 8, 16, 33])
def test_elimination_is_exact_with_ties(width):
    rng = np.random.default_rng(width)
    for spread in (1, 3, 1000, (1 << 30) // 128):
        x, entries = rng.integers(-spread, spread + 1, (300, width)), rng.integers(-spread, spread + 1, (256, width))
        entries[100:110] = entries[:10]
        got, distance = codes.nearest(codes.transform(x), codes.transform(entries))
        expected, least = plain_nearest(x, entries)
        length = 1 << max(0, width - 1).bit_length()
        assert got.tolist() == expected.tolist() and (distance // length).tolist() == least.tolist() and not (distance % length).any()


def test_elimination_leaves_few_pairs():
    """On smooth vectors most entries go by their first coefficients."""
    rng = np.random.default_rng(1)
    x, entries = (np.cumsum(rng.integers(-50, 51, (n, 16)), axis=1) for n in (500, 256))
    c, e = codes.transform(x), codes.transform(entries)
    partial = ((c[:, None, :4] - e[None, :, :4]) ** 2).sum(axis=2)
    _, least = codes.nearest(c, e)
    assert (partial <= least[:, None]).mean() < 0.1


def test_decoding_gives_the_entries(spark):
    rows = [(i, [math.sin(i * j) for j in range(8)], 1, "", "") for i in range(50)]
    vectors = codes.integers(spark.createDataFrame(rows, SCHEMA))
    books = codes.train(vectors)
    encoded = codes.encode(vectors, books)
    errors = {r.vec_id: r.error for r in encoded.collect()}
    back = {r.vec_id: r.v for r in codes.decode(encoded, books, 8).collect()}
    for r in vectors.collect():
        assert sum((a - b) ** 2 for a, b in zip(r.v, back[r.vec_id], strict=True)) == errors[r.vec_id]
