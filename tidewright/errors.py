"""Exceptions of the library."""


class MissingColumnsError(ValueError):
    """An operator was given a table without a column it needs."""
