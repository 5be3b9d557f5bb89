"""Bar analytics and signal-outcome research as Spark DataFrame jobs."""
