"""Operators over DataFrames: rollups, universes, metrics, ingest, simulation, monitoring, text."""
