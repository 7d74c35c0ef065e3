"""DataFrame operators, grouped by the step of the analysis they belong to."""
