"""Seasonal-timing (phenology) analytics as Spark DataFrame transforms."""

from leafclock.params import ANIMALS, AUTUMN, PLANTS, Params

__all__ = ["ANIMALS", "AUTUMN", "PLANTS", "Params"]
