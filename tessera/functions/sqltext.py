"""SQL fragments: splitting, aliases, and names that other dialects use."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Function names of a common analytic dialect and their Spark equivalents.
RENAMED = {
    "regexp_matches": "regexp_like",
    "string_agg": "listagg",
    "epoch_us": "unix_micros",
    "list_contains": "array_contains",
    "list_distinct": "array_distinct",
    "quantile_cont": "percentile",
    "arg_max": "max_by",
    "arg_min": "min_by",
    "stddev": "stddev_samp",
    "std": "stddev_samp",
    "variance": "var_samp",
    "mean": "avg",
    "strlen": "octet_length",
}
#: Aggregates that keep nulls, and lengths of strings or lists: rewritten with their arguments.
_LISTS, _LENGTH = ("array_agg", "list"), "len"
AGGREGATES = frozenset("avg bool_and bool_or collect_list collect_set count count_if corr covar_pop covar_samp first kurtosis last listagg max max_by median min min_by percentile percentile_approx skewness stddev_pop stddev_samp sum var_pop var_samp".split())
_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|[A-Za-z_][A-Za-z_0-9]*|\s+|.", re.DOTALL)


def tokens(sql: str) -> list[str]:
    return _TOKEN.findall(sql)


def _closing(parts: list[str], at: int) -> int:
    """Place of the bracket that closes the one at a place."""
    depth = 0
    for i in range(at, len(parts)):
        depth += (parts[i] == "(") - (parts[i] == ")")
        if not depth:
            return i
    raise ValueError(f"a bracket is not closed in {''.join(parts)!r}")


def _next(parts: list[str], at: int) -> int:
    """Place of the first token from a place on that is not white space."""
    while at < len(parts) and parts[at].isspace():
        at += 1
    return at


def _gathered(inner: str, condition: str) -> str:
    """A list aggregate with its nulls."""
    once = re.match(r"(?is)\s*distinct\s+(.*)", inner)
    out = f"transform(collect_list(struct({once[1] if once else inner} as v)){condition}, kept_ -> kept_.v)"
    return f"array_distinct({out})" if once else out


def _length(inner: str, df: DataFrame | None) -> str:
    """Components of a list or map, characters of a string."""
    try:
        kind = df.select(F.expr(inner)).schema[0].dataType if df is not None else T.StringType()
    except AnalysisException:  # of a lambda's variable, or of a column that is not there yet
        kind = T.StringType()
    return f"cast(size({inner}) as bigint)" if isinstance(kind, (T.ArrayType, T.MapType)) else f"length({inner})"


def to_spark(sql: str, df: DataFrame | None = None) -> str:
    """Double-quoted identifiers become backticked ones, and functions of the other dialect Spark's; df tells types."""
    parts = tokens(sql)
    out, i = [], 0
    while i < len(parts):
        t, name, at = parts[i], parts[i].lower(), _next(parts, i + 1)
        called = at < len(parts) and parts[at] == "("
        if t[0] == '"':
            t = "`" + t[1:-1].replace('""', '"') + "`"
        elif called and name in (*_LISTS, _LENGTH):
            end = _closing(parts, at)
            inner, i = to_spark("".join(parts[at + 1 : end]), df), end
            if name == _LENGTH:
                t = _length(inner, df)
            else:
                where, condition = _next(parts, end + 1), ""
                if where < len(parts) and parts[where].lower() == "filter":
                    i = _closing(parts, _next(parts, where + 1))
                    condition = " " + to_spark("".join(parts[where : i + 1]), df)
                t = _gathered(inner, condition)
        elif called and name in RENAMED:
            t = RENAMED[name]
        out.append(t)
        i += 1
    return "".join(out)


def split(sql: str) -> list[str]:
    """The parts of a comma-separated list; commas in brackets and quotes do not count."""
    out, depth, part = [], 0, []
    for t in tokens(sql):
        depth += (t in "([{") - (t in ")]}") if len(t) == 1 else 0
        if t == "," and depth == 0:
            out.append("".join(part).strip())
            part = []
        else:
            part.append(t)
    out.append("".join(part).strip())
    return [p for p in out if p]


def aliased(sql: str, df: DataFrame | None = None) -> Iterator[tuple[str, str]]:
    """(expression, name) of each part; a part without `as name` is an error."""
    for part in split(sql):
        parts = [(i, t) for i, t in enumerate(tokens(part)) if not t.isspace()]
        if len(parts) < 3 or parts[-2][1].lower() != "as":
            raise ValueError(f"{part!r} needs an alias: expression as name")
        name = parts[-1][1].strip('`"')
        yield to_spark("".join(tokens(part)[: parts[-2][0]]).strip(), df), name


def over(sql: str, frame: str) -> str:
    """The expression with each aggregate call taken over a window."""
    parts, out, i = tokens(to_spark(sql)), [], 0
    while i < len(parts):
        if parts[i].lower() in AGGREGATES and "".join(parts[i + 1 :]).lstrip().startswith("("):
            depth, j = 0, i + 1
            while True:
                depth += (parts[j] == "(") - (parts[j] == ")")
                j += 1
                if depth == 0 and parts[j - 1] == ")":
                    break
            out.append("".join(parts[i:j]) + f" OVER ({frame})")
            i = j
        else:
            out.append(parts[i])
            i += 1
    return "".join(out)
