"""Errors that reach the driver. Per-row trouble is a column, not an exception."""

from __future__ import annotations


class QuarryError(Exception):
    """Any error of this library."""


class CompressionError(QuarryError):
    """An unknown codec, a level that isn't a number, or bytes that don't decode."""


class IntegrityError(QuarryError):
    """Bytes don't match their hash or tag."""


class DedupError(QuarryError):
    """One hash, different bytes."""


class EncryptionError(QuarryError):
    """A missing key, a key of the wrong length, or a rotation that is under way."""


class CatalogError(QuarryError):
    """A missing or repeated row of the catalog."""


class ViewError(QuarryError):
    """A path, object or volume that doesn't exist, exists already or is of another kind."""
