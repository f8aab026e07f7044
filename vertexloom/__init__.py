"""vertexloom: iterative graph analytics and data processing on PySpark DataFrames."""
