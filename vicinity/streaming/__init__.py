"""Micro-batch and stateful streaming operators."""
