"""A semantic index, retrieval and corpus engine expressed as Spark plans."""
