"""Registered queries over the test tables; each module adds to the catalog."""
