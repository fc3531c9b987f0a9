"""Column functions: text signals (C1-C6), tokenizers (K1), the Python syntax check."""
