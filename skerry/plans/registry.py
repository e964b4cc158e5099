"""All core queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from skerry.plans import annotation, audit, cleaning, evaluation, learning, lists, multivalue

MODULES = (multivalue, cleaning, audit, annotation, evaluation, learning, lists)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
FLAGSHIP = "species_assignments"
