"""flowloom: process-mining analytics on event logs, as Spark DataFrame jobs."""
