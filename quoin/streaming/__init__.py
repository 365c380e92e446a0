"""quoin.streaming."""
