"""Errors of sources and models."""


class RiskError(Exception):
    """Base of this package's errors."""


class ReadError(RiskError):
    """A file is missing or cannot be read."""


class DecodeError(RiskError):
    """A file does not hold what its kind asks for."""
