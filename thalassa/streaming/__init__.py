"""Structured Streaming forms of windowed operators. The reference works on stored series only; these give the same
numbers for series that still grow, with late rows up to a watermark."""

from .windows import block_statistics, levels, quality

__all__ = ["block_statistics", "levels", "quality"]
