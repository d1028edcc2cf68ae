"""Document-dataflow analytics on PySpark: corpus cleaning, retrieval, ranking and evaluation as DataFrame plans."""
