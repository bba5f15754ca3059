"""Repair of conversations against a search over all edits."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from codestrata.llm import queries, repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """Rows (turn, role, text) of one conversation after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.md5(r[2].encode()).hexdigest()))


def brute(rows):
    """Everything of the contract for one conversation's rows, by recursion over whole audits."""
    rows = damaged(rows)
    turns = {t for t, _, _ in rows if t is not None}
    faults, seen = [], set()
    for _, role, text in rows:
        told = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not told else "duplicate" if (role, text) in seen else "none" if told[-1] in ".!?" else "truncated")
        seen.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserted):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 3:
            for name in ("user", "assistant"):
                if to := after.get((state, name[0])):
                    c, a, r = best(i, to, inserted + 1)
                    ways.append((2 + c, "I" + a, (f"{name}:", *r)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, r = best(i + 1, state, 0)
            ways.append((3 + c, "D" + a, r))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                for letter, name, price in [("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)]:
                    if to := after.get((state, name[:1])):
                        c, a, r = best(i + 1, to, 0)
                        ways.append((price + late + c, letter + a, (f"{name}:{text}", *r)))
        return min(ways) if ways else (1 << 40, "", ())

    cost, audit, kept = best(0, "", 0)
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    return {c: brute(r) for c, r in groups.items()}


def found(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string, signature string, cost long, letter string"
ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "useless", "System", "é"]
TEXTS = ["Yes.", "No!", "Why?", "and then", "", " \t", None, "end.\u0085", "end.\n\n ", "Yes. ", "same " * 20 + "a.", "same " * 20 + "b", "　"]


def random_rows(seed, conversations):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        n = rng.choice([1, 1, 2, 3, 4, 6, 9])
        for t in range(n):
            turn = None if rng.random() < 0.05 else t * rng.choice([1, 1, 1, 2]) - (rng.random() < 0.05)
            rows.append((c if rng.random() > 0.01 else None, turn, rng.choice(ROLES) if rng.random() < 0.5 else ("user", "assistant")[t % 2], rng.choice(TEXTS)))
    return rows


def test_repair_equals_a_search_over_all_edits(spark):
    rows = random_rows(1, 900)
    rows += [(r[0], *r[1:]) for r in rows[:50]]  # repeated rows
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    assert found(repair.repair(table)) == expected(rows)
    assert repair.repair(table.limit(0)).count() == 0


def test_given_conversations(spark, sf_dir):
    rows = [tuple(r) for r in queries.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.QUERIES["op12_conversation_repair"](spark, sf_dir)) == expected(rows)


def test_every_short_signature():
    """All words of up to four letters, in sorted and in random order, against the search; nodes of shared ends are made once."""

    def search(signature):
        after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

        @lru_cache(None)
        def best(i, state, inserted):
            ways = [(0, "")] if i == len(signature) and state in ("", "a") else []
            for name in "ua" if inserted < 3 else "":
                if to := after.get((state, name)):
                    ways.append((2 + best(i, to, inserted + 1)[0], "I" + best(i, to, inserted + 1)[1]))
            if i < len(signature):
                c = signature[i]
                ways.append((3 + best(i + 1, state, 0)[0], "D" + best(i + 1, state, 0)[1]))
                for letter, name, price in [("K", c.lower(), 0), ("R", "u", 2), ("R", "a", 2)] if c != "x" else []:
                    if to := after.get((state, name)):
                        ways.append((price + c.isupper() + best(i + 1, to, 0)[0], letter + best(i + 1, to, 0)[1]))
            return min(ways) if ways else (1 << 40, "")

        return best(0, "", 0)

    words = ["".join(w) for n in range(5) for w in itertools.product("suaoSUAOx", repeat=n)]
    automaton = repair.Automaton()
    for word in sorted(words, key=lambda w: w[::-1]):
        assert automaton.audit(word) == search(word), word
    assert automaton.made == len(words) - 1  # a node for each distinct end
    assert len(automaton.costs) < 200  # and few classes of nodes
    random.Random(1).shuffle(words)
    other = repair.Automaton()
    assert all(other.audit(w) == search(w) for w in words[:2000])


def test_edits_lead_to_the_grammar():
    rng = random.Random(5)
    automaton = repair.Automaton()
    for _ in range(300):
        word = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 60)))
        cost, audit = automaton.audit(word)
        names = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
        left = [*repair.repaired(iter([(names[c.lower()], "t") for c in word]), audit)]
        assert GRAMMAR.fullmatch("".join(r[0] for r, _ in left))
        assert sum(e != "I" for e in audit) == len(word)
        late = sum(c in "SUAO" and e != "D" for c, e in zip(word, audit.replace("I", ""), strict=True))
        assert cost == late + sum({"K": 0, "R": 2, "D": 3, "I": 2}[e] for e in audit)


def test_a_long_conversation(spark):
    n = 60_000
    rows = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(n)]
    r = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    kept = damaged(rows)
    assert len(r) == 1 and sum(e != "I" for e in r[0].audit) == len(kept) and r[0].duplicate == sum(a == b for a, b in itertools.pairwise(kept))


@pytest.mark.parametrize("text, fault", [("a. ", "truncated"), ("a.\x0b\x0c", "none"), ("?" + " " * 100_000, "none"), (" " * 100_000, "blank")])
def test_last_character(spark, text, fault):
    rows = repair.faults(spark.createDataFrame([(1, 1, "user", text, False)], "conv_id long, turn long, role string, text string, gone boolean"))
    assert rows.first().fault == fault
