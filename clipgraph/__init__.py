"""Spark operators for video event graphs: clips, annotations, tracks, predictions, graphs."""
