"""Readers, writers and views that give GraphTables."""
