"""DataFrame -> DataFrame operators, grouped by pipeline stage."""
