"""Build large expressions once per Spark context.

A wide extraction takes thousands of calls into the JVM to build. Columns are immutable and
name their inputs, so the same expression serves every plan of a context. What an earlier context
built is dropped when another one is seen.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext

_built: dict = {}
_context: list = []


def per_context(build):
    """Cache the result of a builder whose arguments are plain values."""

    @functools.wraps(build)
    def cached(*args):
        context = SparkContext.getOrCreate()
        if not _context or _context[0] is not context:
            _built.clear()
            _context[:] = [context]
        key = (build.__module__, build.__qualname__, args)
        if key not in _built:
            _built[key] = build(*args)
        return _built[key]

    return cached
