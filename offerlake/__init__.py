"""Offer analytics on Spark: extraction, ingest, catalogue, builder and schedule queries."""
