"""Marts, metrics, report datasets and reconciliation built from the operators."""
