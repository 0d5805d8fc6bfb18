"""Lattices, sets, maps and graphs as DataFrame operators."""
