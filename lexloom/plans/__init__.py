"""Registered queries: importing the package fills ``registry.QUERIES``."""

from . import registry, service  # noqa: F401
