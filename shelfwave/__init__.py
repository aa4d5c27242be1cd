"""Attribute trend and shelf analytics on PySpark.

Every operator is a plain function from DataFrames (and parameters) to a DataFrame. Nothing here reads the wall
clock: `today` and `now` are parameters, and thresholds live in :class:`shelfwave.rules.Rules`.
"""

from shelfwave.rules import DEFAULT_RULES, Rules

__all__ = ["DEFAULT_RULES", "Rules"]
