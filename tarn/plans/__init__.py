"""Query languages and the plans of searches."""
