"""Names in texts against a search of all places and lengths."""

import random
import re

import pytest

from codestrata.operators import mentions

TOKEN = re.compile(r"[\w$]+|[^\w$]", re.ASCII)


def brute(text, names):
    """Pieces of a text by trying the longest name at every place."""
    tokens, out, plain, at = TOKEN.findall(text), [], "", 0
    word = lambda i: 0 <= i < len(tokens) and re.fullmatch(r"[\w$]+", tokens[i], re.ASCII) is not None
    is_dot = lambda i: 0 <= i < len(tokens) and tokens[i] == "."
    while at < len(tokens):
        hit = None
        if not (is_dot(at - 1) and word(at - 2)):
            for end in range(len(tokens), at, -1):
                name = "".join(tokens[at:end])
                if name in names and not (word(end - 1) and is_dot(end) and word(end + 1)):
                    hit = end, name
                    break
        if hit:
            out += [(plain, None)] if plain else []
            out.append((hit[1], names[hit[1]]))
            plain, at = "", hit[0]
        else:
            plain, at = plain + tokens[at], at + 1
    return out + ([(plain, None)] if plain else [])


NAMES = {"a.B": "1", "a.B.C": "2", "a": "3", "Outer.Inner": "4", "Inner": "5", "B.run(int,X)": "6#x", "B": "7", "run": "8", "é": "9", "a.B.C.": "10", "x y": "11"}


@pytest.mark.parametrize("most", [100, 0])
def test_longest_names_equal_brute_force(spark, most):
    rng = random.Random(most)
    words = ["a", "B", "C", "Outer", "Inner", "run", "int", "X", "é", "x", "y", "Bx"]
    texts = ["".join(rng.choice([*words, ".", ".", ".", "(", ",", ")", " ", "<"]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    texts += ["See a.B.C, a.B. and a.B.Cx", "B.run(int,X).a", "x.a.B", "", None, "B.run(int,X)", "a.B", "a.B.C.", "a.B.C.x", "x y", "\n a\r\n"]
    names = [*NAMES.items(), ("twice", "p"), ("twice", "q"), (None, "n"), ("", "n"), ("nothing", None)]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, target string")
    found = mentions.find_names(rows, "id", "text", spark.createDataFrame(names, "name string, target string"), most=most).collect()
    assert len(found) == len(texts) and found[0].target == "x"
    for r in found:
        assert (None if r.pieces is None else [(p.text, p.target) for p in r.pieces]) == (None if r.text is None else brute(r.text, NAMES)), r.text


def test_no_names(spark):
    rows = spark.createDataFrame([(1, "a b")], "id int, text string")
    none = spark.createDataFrame([], "name string, target string")
    for most in (5, -1):
        assert [(p.text, p.target) for p in mentions.find_names(rows, "id", "text", none, most).first().pieces] == [("a b", None)]
