"""Inventory decision support as Spark DataFrame operators.

Every public operator takes a DataFrame and returns a DataFrame built from native
Spark expressions.  See README.md for the order in which they are usually chained.
"""

from shelfline.params import DEFAULTS, Params

__all__ = ["DEFAULTS", "Params"]
