"""Endurance-training analytics as Spark DataFrame transformations."""
