"""Imports every module that registers queries."""

from weftline.plans import derived, exact, graphs, io, more, panels, relational, rolling, scores  # noqa: F401
