"""Evidence assessment over event and flow records, as Spark DataFrame jobs."""
