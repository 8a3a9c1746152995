"""Joins, upserts, folds and other whole-table operations."""
