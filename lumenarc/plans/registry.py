"""Every query of the library outside the training-data subpackage, with its SQL."""

from __future__ import annotations

from . import activity, archive, english, entities, files, graphs, identities, library, papers, profiles, retrieval, rulesets, searches, streams

QUERIES, ORACLE = {}, {}
for module in (activity, archive, english, entities, files, graphs, identities, library, papers, profiles, retrieval, rulesets, searches, streams):
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE
