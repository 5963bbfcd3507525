"""Queries registered for the driver, with an independent SQL statement for each."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("cleaning", "selecting", "viewing", "climate", "answering", "texts")

QUERIES: dict = {}
ORACLES: dict = {}
for _family in FAMILIES:
    _module = import_module(f"catalog.{_family}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
