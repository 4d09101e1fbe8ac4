"""Experience analytics on PySpark: step sequences, evidence, retrieval and curation."""
