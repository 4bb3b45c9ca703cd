"""Imports every module that registers views."""

from . import basics, capacity, charts, contracts, entities, grants, kept, network, profiles, search  # noqa: F401
from .registry import VIEWS

__all__ = ["VIEWS"]
