"""Functions of timed text and audio signals."""
