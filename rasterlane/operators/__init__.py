"""All operators; importing this module registers them."""

from . import dropout, gather, geometry, mixing, pointwise, statistics, text, volume, weather
from .base import OPERATORS, Frame, Named, Operator, from_spec, operator

__all__ = ["OPERATORS", "Frame", "Named", "Operator", "dropout", "from_spec", "gather", "geometry", "mixing", "operator", "pointwise", "statistics", "text", "volume", "weather"]
