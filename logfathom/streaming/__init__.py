"""Continuous normalisation, enrichment, ingest and tallies."""
