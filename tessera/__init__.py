"""tessera: a batch-first retrieval analytics engine on PySpark DataFrames."""
