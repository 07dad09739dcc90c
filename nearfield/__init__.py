"""nearfield: vector search, its evaluation and its analytics, expressed as Spark DataFrame plans."""
