"""Annotated-logic graph analytics, provenance reasoning and text extraction on PySpark."""
