"""An extra: an index that follows a folder. Batch refreshes are the engine's own way."""
