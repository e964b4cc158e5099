"""All queries of this package by name, with SQL where it can express them."""

from __future__ import annotations

from skerry.llm import p1, p2, p4, p5, p6, p7, p8, p9

MODULES = (p1, p2, p4, p5, p6, p7, p8, p9)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
