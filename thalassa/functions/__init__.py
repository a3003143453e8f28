"""Column functions: arrays as spectra and profiles, angles and rotations, times, packed fields."""

from . import angles, arrays, codes, times

__all__ = ["angles", "arrays", "codes", "times"]
