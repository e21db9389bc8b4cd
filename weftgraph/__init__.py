"""weftgraph: code-graph analytics and record processing on PySpark DataFrames."""
