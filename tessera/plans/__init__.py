"""The user's API: a context and lazy streams, each a DataFrame and, if declared, a time column."""

from tessera.plans.context import Context
from tessera.plans.stream import Dataset, GroupedStream, OrderedStream, Stream

__all__ = ["Context", "Dataset", "GroupedStream", "OrderedStream", "Stream"]
