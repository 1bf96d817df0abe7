"""coverscope: overlapping neighbourhoods, table contracts and neighbour statistics as Spark jobs."""
