"""Training-data operators.  Nothing outside this folder imports it; its queries are in :mod:`inkspark.llm.queries`."""
