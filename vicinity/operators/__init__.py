"""Dataflow operators: evidence, routing, similarity, digests, warnings, stores."""
