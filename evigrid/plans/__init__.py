"""Bindings of the driver tables to the canonical schemas, and the registered queries."""
