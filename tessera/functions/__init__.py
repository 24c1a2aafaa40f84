"""Functions by category; importing this package fills the registry."""

from . import analytic, dates, files, financial, hierarchy, ml, profiles, rows, scalar, special
from .registry import REGISTRY, call, get

__all__ = ["REGISTRY", "call", "get", "analytic", "dates", "files", "financial", "hierarchy", "ml", "profiles", "rows", "scalar", "special"]
