"""Lineage cuts that survive the loss of an executor: the library's own, under the name used here."""

from __future__ import annotations

from ..storage import drop, materialised, release, scratch, shared_folder

__all__ = ["drop", "materialised", "release", "scratch", "shared_folder"]
