"""Operators for large-scale training-data pipelines, each by one named method.

Nothing outside this subpackage imports it.  ``tessera.llm.queries`` holds the
``opN_<name>`` queries and their SQL.
"""
