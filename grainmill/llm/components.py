"""Connected components, as the library has them."""

from grainmill.operators.graph import components

__all__ = ["components"]
