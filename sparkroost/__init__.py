"""Analytics for systems that choose which language model answers a query, on PySpark."""
