"""Imports every module that registers queries."""

from evalweave.plans import arrays, evaluation, intervals, joining, merging, preferences, retrieving, sampling, scanning, testing, texts  # noqa: F401
