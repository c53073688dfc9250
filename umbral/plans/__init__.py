"""Predicates, pipelines, SQL masking, lineage."""
