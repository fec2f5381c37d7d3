"""corpusgraph: corpus retrieval and knowledge-graph analytics on PySpark."""
