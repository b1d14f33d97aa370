"""Errors of readers and writers; all are RuntimeErrors, as callers of such libraries expect."""


class ImageFileError(RuntimeError, OSError):
    """A file can't be reached."""


class FormatError(RuntimeError, ValueError):
    """A file is malformed or truncated."""


class UnsupportedError(NotImplementedError):
    """A file is valid, but its type or layout isn't supported."""
