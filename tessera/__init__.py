"""tessera: instance tables for very large tiled images, as PySpark DataFrame operators."""

from tessera.session import get_session, stable_copy

__all__ = ["get_session", "stable_copy"]
