"""lyrebird: timed text, audio signals and training-data preparation on Spark."""
