"""Tallywharf: container-code evidence and reconciliation on PySpark."""
