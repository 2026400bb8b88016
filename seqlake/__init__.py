"""Spark-first recording, replay and analysis of sequenced event feeds."""
