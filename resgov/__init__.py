"""resgov — resource-governance analytics on Spark.

Inventory normalisation, decision-log folding, approval-status evaluation,
statistics and migration-ledger audits, all expressed as DataFrame
operations that Catalyst plans and Spark distributes.
"""

__version__ = "0.1.0"
