"""Spark-native engine for timed subtitle text (cues, corrections, timing, admission state)."""
