"""Package folder."""

from . import audits, changes, nearness, registry, upkeep

__all__ = ["audits", "changes", "nearness", "registry", "upkeep"]
