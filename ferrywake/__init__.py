"""Ferrywake: live-transport analytics and data preparation as Spark DataFrame operators."""
