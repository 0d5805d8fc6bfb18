"""meetflow: data-flow analysis and data processing as Spark DataFrame plans."""
