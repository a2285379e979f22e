"""Operators over GraphTables: lazy, keyed by graph_id, whole collections at once."""
