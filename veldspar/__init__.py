"""A multi-model analytics engine on Spark: tables, property graph, vectors, full text and retrieval as DataFrame plans."""
