"""Connected components, as the library has them."""

from leafmill.operators.graph import connected_components

__all__ = ["connected_components"]
