"""quoin.operators."""
