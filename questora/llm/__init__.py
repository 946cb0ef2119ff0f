"""Training-data operators: every module here is one operator over a corpus DataFrame."""
