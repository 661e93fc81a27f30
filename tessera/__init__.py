"""Tessera: review analytics and corpus processing as Spark DataFrame operators."""
