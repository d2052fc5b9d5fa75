"""Secret scan: fixed patterns, then a randomness test battery over other long tokens.

A token's encoding is inferred from its characters (hexadecimal, base 32,
letters and digits, base 64).  Under that alphabet three tests ask whether it
looks uniform: chi-squared of symbol counts, runs about the alphabet's middle,
and lag-one serial correlation.  A token that no test rejects (Bonferroni over
the three) is then held against ordinary writing, whose chi-squared grows with
length; the p-values of that comparison pass Benjamini-Hochberg within their
text.  So a short token needs far better evidence than a long one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import drop_clashing, text_slices, working

# The kinds and patterns of the scan's contract.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Shortest token that the battery looks at, level of the three tests, and false-discovery rate.
MIN_TOKEN, ALPHA, FDR = 20, 0.01, 0.05
#: A whole run of token characters, with one or two "=" as padding only where neither a token nor more "=" follows.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}(?![A-Za-z0-9+/_-])(?:={1,2}(?![A-Za-z0-9+/_=-]))?" % MIN_TOKEN)
#: Chance that two characters of ordinary writing agree (index of coincidence of English).
COINCIDENCE = 0.0655
_ALPHABETS = tuple(
    (re.compile(pattern + r"\Z"), {c: i for i, c in enumerate(symbols)})
    for pattern, symbols in (
        ("[0-9a-f]+", "0123456789abcdef"),
        ("[0-9A-F]+", "0123456789ABCDEF"),
        ("[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
        ("[0-9a-z]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
        ("[0-9A-Z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        ("[A-Za-z0-9+/]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
        ("[A-Za-z0-9_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    )
)


def _below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _odd(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str) -> tuple[float, float] | None:
    """(p that a uniform source is at least as irregular, p that ordinary writing is at most as irregular), or None.

    None: no encoding fits, or the token lacks a letter or a digit.
    """
    token = token.rstrip("=")
    if not any(c.isdigit() for c in token) or not any(c.isalpha() for c in token):
        return None
    for pattern, places in _ALPHABETS:
        if pattern.match(token):
            break
    else:
        return None
    n, k = len(token), len(places)
    if n < 4:
        return None
    at = [places[c] for c in token]
    chi = sum(v * v for v in Counter(at).values()) * k / n - n
    uniform = 1 - _below((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    high = [x >= k / 2 for x in at]
    ups = sum(high)
    if 0 < ups < n:
        mean = 2 * ups * (n - ups) / n + 1
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        runs = _odd((1 + sum(a != b for a, b in zip(high, high[1:])) - mean) / spread) if mean > 2 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    middle = sum(at) / n
    power = sum((x - middle) ** 2 for x in at)
    serial = _odd((sum((a - middle) * (b - middle) for a, b in zip(at, at[1:])) / power + 1 / n) * math.sqrt(n)) if power else 0.0
    written = n * max(0.9, k * COINCIDENCE - 1)  # how far ordinary writing is from uniform, in chi-squared
    ordinary = _below((chi - (k - 1) - written) / math.sqrt(2 * (k - 1) + 4 * written))
    return min(1.0, 3 * min(uniform, runs, serial)), ordinary


def random_spans(text: str) -> list[tuple[int, int]]:
    """Tokens that pass the battery and the false-discovery control of their text."""
    tried = []
    for m in _TOKEN.finditer(text):
        found = battery(m[0])
        if found is not None:
            tried.append((found[1], found[0] >= ALPHA, m.start(), m.end()))
    tried.sort()
    last = max((i for i, x in enumerate(tried) if x[0] <= FDR * (i + 1) / len(tried)), default=-1)
    return sorted((s, e) for _, uniform, s, e in tried[: last + 1] if uniform)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = []
    lowered = text.encode("utf-8", "surrogatepass").lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def spans(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans, and all spans: the battery's are added where they touch no base span."""
    base = base_spans(text)
    extra, at, reach = [], 0, 0  # reach: the furthest end of base spans that begin before the token ends
    for s, e in random_spans(text):
        while at < len(base) and base[at][0] < e:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= s:
            extra.append((s, "random", e))
    return base, sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[1])))


def joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in found)


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns (all of df's by default), then n_assign, n_access, n_hex, n_random, base_sha256, spans, redacted.

    Offsets are code points, ends exclusive.  A null text has no spans and stays null in `redacted`, where each span
    (overlapping ones together) reads ``[SECRET]``; an empty one stays empty.  Texts of any length are looked at whole, in one step each.
    Spans that start together go by kind in the order listed.  Repeated rows come out alike, since tests and the false-discovery control see one
    text at a time; an empty table gives no rows.  Columns named as outputs are replaced.
    """
    new = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("redacted", T.StringType())]
    base = drop_clashing(df, [f.name for f in new if f.name != text])
    keep = base.columns if keep is None else keep
    base = base.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*base.schema.fields[:-1], *new])

    def run(batches):
        working("secrets")
        for whole in batches:
            for batch in text_slices(whole, len(keep)):
                rows: list[list] = [[] for _ in new]
                for t in batch.column(len(keep)).to_pylist():
                    fixed, every = spans(t or "")
                    kinds = Counter(k for _, k, _ in every)
                    for column, v in zip(rows, [*[kinds[k] for k in KINDS], hashlib.sha256(joined(fixed).encode()).hexdigest(), joined(every), redact(t, every)], strict=True):
                        column.append(v)
                arrays = [pa.array(v, pa.int64() if f.dataType == T.LongType() else pa.string()) for v, f in zip(rows, new, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], names=schema.names)

    return base.mapInArrow(run, schema)


def redact(text: str | None, found: list[tuple[int, str, int]], mark: str = "[SECRET]") -> str | None:
    if not found:
        return text
    out, at = [], 0
    for s, _, e in found:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])
