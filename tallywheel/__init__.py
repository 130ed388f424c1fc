"""Token-usage ledger analytics, Spark first."""
