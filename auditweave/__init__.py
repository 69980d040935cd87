"""auditweave: audit-knowledge analytics on Spark."""
