"""Personal data by weak supervision.

Fixed patterns give the base spans.  Wider candidates (names after a title, or with a first name
of the gazetteer, national numbers, bank accounts, phones without a plus, spelt
out addresses) get votes from regex, gazetteer and context labelers.  The votes of
all candidates, base ones included, are counted by pattern; expectation-maximisation
over those counts estimates each labeler's hit and false-alarm rate by kind (drawn towards its rate over all kinds) and the prior by kind.
A logistic span classifier is trained on the resulting soft labels; it sees, beyond the votes, what the labelers do not: the
length and digits of the candidate and the characters beside it.  It decides which candidates become spans; base spans
always stay, but whether they are right is estimated like any other's, so that labelers are weighed on wrong ones too.

Counts by (kind, votes, look) are bounded by the number of such patterns, not by rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import stage, text_slices, working

# The kinds and patterns of the scan's contract.
BASE_KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Kinds that the method adds.
EXTRA_KINDS = ("name", "national", "account", "local_phone", "spelt_email")
KINDS = BASE_KINDS + EXTRA_KINDS
_EXTRA = {
    "name": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-ZÀ-Ý][a-zà-ÿ]+(?: [A-ZÀ-Ý][a-zà-ÿ]+)?"),
    "national": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "account": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "local_phone": re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])"),
    "spelt_email": re.compile(r"\b[A-Za-z0-9._-]{2,64} (?:\[at\]|\(at\)) [A-Za-z0-9-]+(?: (?:\[dot\]|\(dot\)) [A-Za-z0-9-]+)+"),
}
#: A capitalised word and the one after it.
_CAPITALS = re.compile(r"\b([A-ZÀ-Ý][a-zà-ÿ]+)(?=( [A-ZÀ-Ý][a-zà-ÿ]+))")
# Gazetteers and context words of the labelers.
FIRST_NAMES = frozenset(
    """
    james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah
    charles karen christopher nancy daniel lisa matthew betty anthony margaret mark sandra donald ashley steven kimberly paul emily
    andrew donna joshua michelle kenneth carol kevin amanda brian dorothy george melissa edward deborah ronald stephanie timothy rebecca
    jason laura jeffrey helen ryan sharon jacob cynthia gary kathleen nicholas amy eric angela jonathan anna stephen ruth larry brenda
    justin pamela scott nicole brandon katherine benjamin samantha samuel christine gregory emma frank catherine alexander virginia
    hans peter klaus wolfgang jürgen uwe stefan andreas petra ursula monika sabine heike birgit claudia katrin greta lukas felix
    pierre jean marie michel philippe alain nathalie isabelle sylvie françoise luc camille chloé hugo louis jacques claire julien
    josé carlos juan maria sofia luis miguel javier carmen ana isabel pilar dolores antonio manuel francisco lucía pablo diego elena
    """.split()
)
DOMAINS = ("gmail", "yahoo", "hotmail", "outlook", "mail", "example")
COUNTRIES = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
FOR_WORDS = re.compile(r"(?i)\b(?:e-?mail|contact|write|mailto|call|phone|tel|mobile|fax|card|visa|account|iban|ssn|social|host|server|address|name|from|by|signed|dear)\b")
AGAINST_WORDS = re.compile(r"(?i)\b(?:version|isbn|order|invoice|page|figure|table|section|release|build|sku|model)\b")
CONTEXT = 40
_TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof")
LABELERS = ("checksum", "shape", "gazetteer", "context_for", "context_against")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses, found from their at signs, in time linear in the text."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
        done = max(done, start)
    return found


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = [(s, "email", e) for s, e in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            found.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), "phone", m.end()))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def candidates(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Wider candidates that touch no base span, the first of overlapping ones."""
    found = [(m.start(), KINDS.index(k), m.end()) for k, p in _EXTRA.items() for m in p.finditer(text)]
    found += [(m.start(), KINDS.index("name"), m.end(2)) for m in _CAPITALS.finditer(text) if m[1].lower() in FIRST_NAMES]
    found.sort()
    kept, taken = [], sorted((s, e) for s, _, e in base)
    done, j = 0, 0
    for s, k, e in found:
        while j < len(taken) and taken[j][1] <= s:
            j += 1
        if s >= done and not (j < len(taken) and taken[j][0] < e):
            kept.append((s, KINDS[k], e))
            done = e
    return kept


def votes(text: str, start: int, kind: str, end: int) -> int:
    """The labelers' votes, three-valued (0 abstains, 1 for, 2 against), as one number in base 3."""
    value = text[start:end]
    digits = "".join(c for c in value if c.isascii() and c.isdigit())
    near = text[max(0, start - CONTEXT) : start]
    words = re.findall(r"[^\W\d_]+", value)
    titled = kind == "name" and words[0] in _TITLES
    out = []
    if kind == "account":
        raw = value.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in raw[4:] + raw[:4])
        out.append(1 if int(number) % 97 == 1 else 2)
    elif kind == "card":
        out.append(1 if luhn(digits) else 2)
    elif kind == "national":
        out.append(2 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1)
    else:
        out.append(int(titled))
    shapes = {"email": len(value) <= 254, "ip": len(digits) >= 6, "card": digits[:1] in "3456", "phone": len(digits) >= 10, "name": len(words) == 2 + titled, "national": True, "account": 15 <= len(value.replace(" ", "")) <= 34, "local_phone": digits[:1] not in "01", "spelt_email": True}
    out.append(1 if shapes[kind] else 2)
    if kind == "name":
        out.append(1 if any(w.lower() in FIRST_NAMES for w in words[titled:]) else 0)
    elif kind in ("email", "spelt_email"):
        out.append(1 if any(d in value.lower() for d in DOMAINS) else 0)
    elif kind == "account":
        out.append(1 if value[:2] in COUNTRIES else 2)
    else:
        out.append(0)
    out.append(1 if FOR_WORDS.search(near) else 0)
    out.append(2 if AGAINST_WORDS.search(near) else 0)
    code = 0
    for v in out:
        code = code * 3 + v
    return code


#: Values of each part of a look: length, share of digits, and kind of character before and after.
LOOKS = (4, 3, 4, 4)


def _beside(c: str) -> int:
    return 0 if c in ("", "\n") else 1 if c.isspace() else 2 if not c.isalnum() else 3


def look(text: str, start: int, end: int) -> int:
    """What the labelers do not see of a candidate, as one number."""
    digits = sum(c.isdigit() for c in text[start:end])
    parts = min(3, (end - start) // 10), min(2, 3 * digits // (end - start)), _beside(text[start - 1 : start] if start else ""), _beside(text[end : end + 1])
    code = 0
    for n, v in zip(LOOKS, parts, strict=True):
        code = code * n + v
    return code


def _look_parts(code: int) -> list[int]:
    out = []
    for n in reversed(LOOKS):
        out.append(code % n)
        code //= n
    return out[::-1]


def _digits3(code: int) -> list[int]:
    return [code // 3**i % 3 for i in reversed(range(len(LABELERS)))]


#: Votes (0, 1, 2) that a labeler is thought to cast on wrong and on right candidates before any are seen, and how many such votes count.
_EXPECTED, _COUNTED = ((0.5, 0.15, 0.35), (0.3, 0.6, 0.1)), 10


def estimate(patterns: list[tuple[str, int, int, int]], rounds: int = 50) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """EM over (kind, votes, look, count): P(true) of each pattern, and the labelers' rates over all kinds [truth, labeler, vote].

    A labeler has rates of its own for each kind; those over all kinds count as _COUNTED votes more.
    """
    if not patterns:
        return {}, np.full((2, len(LABELERS), 3), 1 / 3)
    cast = np.array([_digits3(v) for _, v, _, _ in patterns])
    weight = np.array([n for *_, n in patterns], float)
    kind = np.array([KINDS.index(k) for k, *_ in patterns])
    labelers = np.arange(len(LABELERS))
    pooled = np.repeat(np.array(_EXPECTED)[:, None, :], len(LABELERS), axis=1)
    rate = np.repeat(pooled[:, None], len(KINDS), axis=1)
    prior = np.where(np.arange(len(KINDS)) < len(BASE_KINDS), 0.95, 0.5)
    p = np.zeros(len(patterns))
    for _ in range(rounds):
        like = np.stack([np.log(rate[z][kind[:, None], labelers, cast]).sum(1) for z in (0, 1)])
        odds = like[1] - like[0] + np.log(prior[kind]) - np.log1p(-prior[kind])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        for z, q in ((1, weight * p), (0, weight * (1 - p))):
            seen = np.zeros((len(KINDS), len(LABELERS), 3))
            for j in labelers:
                np.add.at(seen, (kind, j, cast[:, j]), q)
            pooled[z] = seen.sum(0) + np.array(_EXPECTED[z]) * _COUNTED
            pooled[z] /= pooled[z].sum(1, keepdims=True)
            rate[z] = seen + pooled[z] * _COUNTED
            rate[z] /= rate[z].sum(2, keepdims=True)
        for k in range(len(KINDS)):
            own, before = kind == k, 95 if k < len(BASE_KINDS) else 5
            prior[k] = min(0.99, ((weight * p)[own].sum() + before) / (weight[own].sum() + (100 if k < len(BASE_KINDS) else 10)))
    return {f"{k}:{v}:{s}": float(x) for (k, v, s, _), x in zip(patterns, p, strict=True)}, pooled


def _features(patterns: list[tuple[str, int, int]]) -> np.ndarray:
    rows = []
    for k, v, s in patterns:
        row = [1.0] + [float(k == x) for x in KINDS]
        for n, part in zip(LOOKS, _look_parts(s), strict=True):
            row += [float(part == x) for x in range(n)]
        for d in _digits3(v):
            row += [float(d == 1), float(d == 2)]
        rows.append(row)
    return np.array(rows)


def train(patterns: list[tuple[str, int, int, int]], steps: int = 400) -> np.ndarray:
    """Weights of the span classifier: logistic regression on the soft labels, by gradient steps over pattern counts."""
    soft, _ = estimate(patterns)
    width = 1 + len(KINDS) + sum(LOOKS) + 2 * len(LABELERS)
    w = np.zeros(width)
    if not patterns:
        return w
    x = _features([p[:3] for p in patterns])
    y = np.array([soft[f"{k}:{v}:{s}"] for k, v, s, _ in patterns])
    n = np.array([c for *_, c in patterns], float)
    n = n / n.sum() + 1e-3 / len(n)  # rare patterns count a little too
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (n * (p - y)) + 1e-5 * w)
    return w


_CAND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("votes", T.IntegerType()), T.StructField("look", T.IntegerType())]))


def propose(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, found): the base spans and the wider candidates of each text, with the labelers' votes."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("base", _CAND), T.StructField("found", _CAND)])
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(_CAND)

    def run(batches):
        working("pii")
        for whole in batches:
            for batch in text_slices(whole, 1):
                base, found = [], []
                for t in batch.column(1).to_pylist():
                    t = t or ""
                    fixed = base_spans(t)
                    for out, got in ((base, fixed), (found, candidates(t, fixed))):
                        out.append([{"kind": k, "start": s, "end": e, "votes": votes(t, s, k, e), "look": look(t, s, e)} for s, k, e in got])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(found, kind)], names=["key", "base", "found"])

    return rows.mapInArrow(run, schema)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans (all), one row for each input row.

    Offsets are code points, ends exclusive.  A null or empty text has no spans; long texts are taken whole.  Texts are read once; what
    the labelers saw is kept in the shared folder, as small as the candidates.  No candidates leave the base spans alone.
    Repeated rows come out alike, and count as often as they are there.  Spans that start together go by kind in the order listed; of
    candidates that overlap the first stays, one that touches a base span goes.  Other columns, whatever their names, are not looked at;
    an empty table gives no rows.
    """
    seen = stage(propose(df, key, text), "pii")
    every = seen.select(F.explode(F.concat("base", "found")).alias("c")).groupBy("c.kind", "c.votes", "c.look").count()
    patterns = sorted((r["kind"], r["votes"], r["look"], r["count"]) for r in every.collect())  # at most 9 * 3**5 * 192
    weights = train(patterns)
    known = [p[:3] for p in patterns if p[0] in EXTRA_KINDS]
    good = {p for p, z in zip(known, _features(known) @ weights, strict=True) if z >= 0} if known else set()
    schema = T.StructType([T.StructField(key, seen.schema["key"].dataType), *[T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in schema.names[1:]]
            for base, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                fixed = [(c["start"], c["kind"], c["end"]) for c in base]
                more = [(c["start"], c["kind"], c["end"]) for c in found if (c["kind"], c["votes"], c["look"]) in good]
                every = sorted(fixed + more, key=lambda x: (x[0], KINDS.index(x[1])))
                kinds = Counter(k for _, k, _ in fixed)
                text = ",".join(f"{k}:{s}:{e}" for s, k, e in fixed)
                for column, v in zip(out, [*[kinds[k] for k in BASE_KINDS], hashlib.sha256(text.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, k, e in every)], strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.int64()) for v in out[:4]], *[pa.array(v, pa.string()) for v in out[4:]]], names=schema.names)

    return seen.mapInArrow(run, schema)
