"""Small tables with every awkward row, shared by the operators' tests."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, shard int, sig string, rid long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(n, seed=0):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 9999)}" for _ in range(n))


def edge_rows():
    base = sentence(60, 1)
    near = base.split()
    near[30] = "changed"
    rows = [
        (1, base), (2, base), (2, base),              # copies, one row repeated
        (3, " ".join(near)),                          # a near copy
        (4, None), (None, None),                      # nulls
        (5, ""), (6, "   \n\t "), (7, "!!! ..."),     # nothing to hash
        (8, "one two"), (9, "one two"),               # shorter than a shingle
        (None, sentence(40, 5)), (None, sentence(40, 5)),
        (10, sentence(9000, 3)),                      # very long
        (11, "x" * 50_000),                           # one very long word
        (12, "İstanbul ǅ ß 中文 \u0000 \U0001F600 é"),
    ]
    return [(i, t, "en" if t else None, None, None, "clash", 77, "s", -1) for i, t in rows]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    """Maximal runs of letters and digits of the lower-cased text, by str.isalnum."""
    out, run = [], ""
    for c in (text or "").lower():
        if c.isalnum():
            run += c
        elif run:
            out.append(run)
            run = ""
    return out + [run] if run else out


def shingles(text, k=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def similar(a, b):
    return bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b)


def pattern_spans(text, pattern, kind, keep=lambda m: True):
    return [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if keep(m)]
