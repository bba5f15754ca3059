"""Small tables with the odd cases that every operator must take."""

import random
import re

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, member string"


def documents(spark, texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", 7, None) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, COLUMNS)


def corpus(seed=1, n=60):
    """Random texts with copies, near copies, shared passages, and odd ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    out = []
    for _ in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 90))]
        if rng.random() < 0.3:
            at = rng.randint(0, len(text))
            text[at:at] = passage
        if out and rng.random() < 0.3:
            text = list(rng.choice(out))
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
        out.append(text)
    texts = [" ".join(t) for t in out]
    texts += [None, "", " \t\n", "one", "one two", "one two", "ONE two", "a\u00a0b c\x0bd\x1ce", texts[0], texts[0].upper()]
    texts.append(" ".join(rng.choice(words) for _ in range(6000)))
    return texts


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})
