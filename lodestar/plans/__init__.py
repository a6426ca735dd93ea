"""Plans of the search engine."""
