"""All queries by name."""

from . import matching, profile, reporting  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
