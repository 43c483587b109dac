"""Spark jobs over circuit-design datasets and the code-model datasets beside them."""
