"""All queries on the reference tables, by id."""

from . import elementwise, keyed, series, tensors, typed  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
