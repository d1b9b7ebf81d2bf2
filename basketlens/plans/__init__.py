"""Compositions: the method study and the registered queries."""
