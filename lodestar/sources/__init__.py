"""Sources of the search engine."""
