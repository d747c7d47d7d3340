"""Document and entity-graph analytics on Spark: every operator takes and returns DataFrames."""
