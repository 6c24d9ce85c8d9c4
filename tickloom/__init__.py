"""Market-panel analytics and training-data preparation as Spark jobs."""
