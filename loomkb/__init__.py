"""Knowledge-base retrieval and service analytics as Spark DataFrame jobs."""
