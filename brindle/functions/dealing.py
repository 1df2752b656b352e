"""How rows are dealt to tasks ahead of work that costs more than reading them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def remembered(f: Callable, most: int = 4096) -> Callable:
    """f with its last results by arguments, at most ``most`` of them a task: messages and values repeat.  A plain closure, which travels by value; callers do not change what it returns."""
    memo: dict = {}

    def run(*args, **named):
        key = (args, tuple(sorted(named.items()))) if named else (args,)
        if key not in memo:
            if len(memo) >= most:
                memo.clear()
            memo[key] = f(*args, **named)
        return memo[key]

    run.__doc__, run.__name__ = f.__doc__, f.__name__
    return run


def spread(rows: DataFrame, *keys: str, each: int = 50_000) -> DataFrame:
    """Rows dealt by keys to three tasks a core at least, and of about ``each`` rows at most: a small file is read by one task, whatever Python or an aggregation has to do with its rows.

    The rows are counted first, so they should be those of a table.
    """
    tasks = max(3 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))
    return rows.repartition(tasks, *keys)
