"""Billing documents on Spark: extraction, reconciliation, redaction, de-identification."""

__version__ = "0.1.0"
