"""Connected components: the library's own, under the name used here."""

from __future__ import annotations

from ..operators.components import components

__all__ = ["components"]
