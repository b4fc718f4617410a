"""The immutable edit builder and its rewrite rules."""
from .builder import Edit, edit  # noqa: F401
