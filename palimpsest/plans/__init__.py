"""Named query plans over the driver tables; importing a module registers its queries."""

from palimpsest.plans import blocks, feeds, graph, imports, measures, reports, sessions, temporal, text, views  # noqa: F401
