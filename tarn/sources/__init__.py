"""Where documents, configurations and training examples come from, and where an index is kept."""
