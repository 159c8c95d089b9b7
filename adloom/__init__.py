"""Bulk creative re-layout on Spark."""
