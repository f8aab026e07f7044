"""Errors of the library."""


class VertexloomError(Exception):
    """Base of all errors of the library."""


class InvalidArgument(VertexloomError):
    """An input or a parameter that does not satisfy its contract."""


class StorageError(VertexloomError):
    """A file or folder that cannot be read or written."""


class InternalError(VertexloomError):
    """A failure that is not the caller's."""
