"""Composite queries, their binding to the test tables, and their SQL."""

from emberfold.plans import borders, extras, grid, impact, layers, playback, scalar, shapes, space

BOOKS = (scalar.BOOK, space.BOOK, impact.BOOK, grid.BOOK, shapes.BOOK, borders.BOOK, playback.BOOK, layers.BOOK, extras.BOOK)
QUERIES = {k: f for b in BOOKS for k, f in b.queries.items()}
ORACLE_SQL = {k: s for b in BOOKS for k, s in b.sql.items()}
