"""Structured Streaming: stateless filter/tokenise, the stateful packer, the running funnel."""
