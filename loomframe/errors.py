"""Errors that operators raise while a query is built."""


class FrameError(ValueError):
    """Base of all errors of this library."""


class ColumnNotFound(FrameError):
    """A column that is named does not exist."""


class DuplicateColumn(FrameError):
    """A column would be there twice."""


class InvalidShape(FrameError):
    """Lengths do not agree."""


class InvalidArgument(FrameError):
    """An argument has a value that the operator does not take."""


class KeyNotFound(FrameError):
    """A label does not exist."""


class IndexOutOfBounds(FrameError):
    """A position lies outside the frame."""


class NotFitted(FrameError):
    """A transformer or model is used before it is fitted."""
