"""Imports every module of queries, so that the registry is full."""

from . import blocks, components, labels, objects, project, regions, resample, stencil, watershed  # noqa: F401
from .views import registry

__all__ = ["registry"]
