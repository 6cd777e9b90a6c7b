"""Composite jobs built from the operators, and the catalogue of registered queries."""
