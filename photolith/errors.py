"""The library's errors."""


class PhotolithError(Exception):
    """Base of all errors raised here."""


class ConfigError(PhotolithError):
    """A configuration that is missing, malformed, or asks for what isn't supported."""


class ConstraintError(PhotolithError):
    """Rows that break a uniqueness, reference or schema rule."""


class SourceError(PhotolithError):
    """A source or sink that can't be used as asked."""


class ConflictError(PhotolithError):
    """A stored table that another writer changed while this one was at work."""
