"""Small documents with every awkward case."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, spans string, size long, target double, n long, sid long, node long, key long, start long, length long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def rows():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = [base, " ".join(near), base, None, "", " \t\n\x0b\r ", "one two three", "One TWO three", prose(2, 4000), prose(2, 4000), "12345 678", "é " * 50, "a\x00b  c  d", "x" * 30000, "word " * 300]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[0], out[0], (None, base, "en", "s1", 1), (None, None, None, None, None)]
    return [(*r, 0.5, "zz", "x", 1, 1.0, 1, 1, 1, 1, 1, 1) for r in out]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
