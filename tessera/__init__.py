"""tessera: retrieval and evaluation analytics as PySpark DataFrame operators."""
