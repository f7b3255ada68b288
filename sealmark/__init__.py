"""sealmark: append-only evidence-ledger analytics as Spark DataFrame jobs."""
