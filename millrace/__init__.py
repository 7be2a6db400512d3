"""Spark-native data-platform operators: landing, modelling, quality, history, lineage, analysis."""
