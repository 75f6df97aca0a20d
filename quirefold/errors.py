"""Errors that callers can tell apart."""


class QuirefoldError(Exception):
    """Base of all errors of this library."""


class DatabaseError(QuirefoldError):
    """A root that is not a directory, or a collection name that cannot be one."""


class CollectionError(QuirefoldError):
    """A collection whose schema cannot be read or parsed."""


class RecordError(QuirefoldError):
    """A record path that is not allowed, or a record that cannot be read."""


class FrontMatterError(RecordError):
    """Front matter that is not closed, or is not valid."""


class SchemaError(QuirefoldError):
    """A schema that breaks the rules of schemas."""


class IndexError_(QuirefoldError):
    """An index that cannot be stored or loaded."""


class ViewError(QuirefoldError):
    """A view name or group value that cannot be a path segment, or a collection outside the database."""
