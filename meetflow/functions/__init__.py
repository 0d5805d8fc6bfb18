"""Scalar expressions: kinds, packed ids, types, instructions, ranges."""
