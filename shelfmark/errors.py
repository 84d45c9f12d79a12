"""Errors the catalogue raises."""


class CatalogueError(Exception):
    """Base of all errors raised by this package."""


class DuplicateImageError(CatalogueError):
    """A hash to insert occurs twice, in the batch or against the registry."""


class ImageNotFoundError(CatalogueError):
    """A tag or note refers to an image that is not in the registry."""


class ImageInUseError(CatalogueError):
    """An image to delete still has tags or a note."""


class InvalidRowError(CatalogueError):
    """A row breaks a NOT NULL or key rule."""


class ConcurrentWriteError(RuntimeError):
    """Another writer committed first; the batch left nothing that readers see."""
