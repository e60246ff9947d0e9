"""firmlens: entity intelligence over registry feeds, filings and documents, as Spark DataFrame jobs."""
