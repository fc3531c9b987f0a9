"""DataFrame -> DataFrame operators: quality, prefix sums, tokenise, packing, splits, SFT, manifest, evaluation, metrics."""
