"""The catalog of registered queries."""
