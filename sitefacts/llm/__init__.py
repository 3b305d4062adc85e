"""Training-data operators over the text tables."""
