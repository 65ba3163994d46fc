"""Tabular analytics and predictive data preparation as Spark DataFrame operators."""
