"""Maximum-parsimony analytics over many sequence alignments, as Spark DataFrame jobs."""
