"""Data quality, cleaning, drift and lineage impact as Spark DataFrame jobs."""
