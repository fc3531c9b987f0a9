"""Developer tools: the oracle check."""
