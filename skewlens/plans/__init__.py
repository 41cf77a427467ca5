"""Analyses assembled from the operators: chart data sets, the report and the whole audit."""
