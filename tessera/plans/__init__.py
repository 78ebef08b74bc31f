"""Derived panels and the registered queries."""
