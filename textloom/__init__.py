"""Labelled-text classification studies as Spark DataFrame plans."""
