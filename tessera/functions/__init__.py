"""Column expressions: operators, the string and datetime namespaces, and SQL text helpers."""

from tessera.functions.expression import Expression, col, lit, unwrap

__all__ = ["Expression", "col", "lit", "unwrap"]
