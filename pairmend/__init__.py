"""Finding and repairing mismatches between the text and image halves of catalog rows, on Spark."""
