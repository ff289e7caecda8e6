"""Cutting lineage, and stages that are materialised once."""
