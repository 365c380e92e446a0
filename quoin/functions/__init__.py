"""quoin.functions."""
