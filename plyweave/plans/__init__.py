"""Registered queries over the test tables and their SQL twins."""

from . import alignment, files, pages, presence, tokens, trees  # noqa: F401
