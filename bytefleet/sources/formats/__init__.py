"""Parsers and writers of single containers: plain Python over bytes, without Spark. Malformed input raises FormatError."""


class FormatError(ValueError):
    """The bytes are not what the format asks for."""
