"""Errors raised at plan time, before any Spark job is started where possible."""


class DescriaError(ValueError):
    """Base class of every error this package raises on purpose."""


class MissingColumnError(DescriaError):
    """A required column is absent; the message lists all absent names."""


class NonNumericColumnError(DescriaError):
    """A feature column is not numeric."""


class EmptySelectionError(DescriaError):
    """An elimination or selection step would leave no feature."""


class RowCountMismatchError(DescriaError):
    """Two inputs that must line up row by row have different lengths."""


class UnsupportedFormatError(DescriaError):
    """A path does not end in one of the accepted suffixes."""


class UnknownCatalogError(DescriaError):
    """A screening database name is not in the catalogue."""


class SearchTooLargeError(DescriaError):
    """A combination search would exceed the configured number of candidates."""


class NotConvergedError(DescriaError):
    """An iterative fit did not reach its tolerance within its rounds."""
