"""quoin.plans."""
