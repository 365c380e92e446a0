"""quoin.sources."""
