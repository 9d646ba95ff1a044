"""DataFrame -> DataFrame data operators, one module per phase of the analysis."""
