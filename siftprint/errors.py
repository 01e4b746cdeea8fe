"""Errors that callers can act on."""


class SiftprintError(Exception):
    """Any error of this library."""


class InvalidInput(SiftprintError, ValueError):
    """An argument or a row that has no defined result."""
