"""Transcript, text-privacy and recording-timeline analytics on Spark."""
