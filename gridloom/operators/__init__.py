"""Operators on rasters and point sets; importing this module registers all of them."""

from . import colour, focal, landforms, local, points, sources, water  # noqa: F401
from .base import OPERATORS, Raster, apply

__all__ = ["OPERATORS", "Raster", "apply"]
