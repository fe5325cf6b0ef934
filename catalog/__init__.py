"""Registered queries: one per operator, each beside the SQL that must give the same rows."""

from catalog import data, evaluation, explaining, fitting, modelling, runs  # noqa: F401
from catalog.base import REGISTRY, Entry  # noqa: F401
