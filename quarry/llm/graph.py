"""Connected components of a table of links; the engine's plan of that name."""

from __future__ import annotations

from quarry.plans.components import components

__all__ = ["components"]
