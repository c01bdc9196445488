"""Intrusion-alert analytics expressed as Spark DataFrame operators."""
