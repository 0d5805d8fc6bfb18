"""The fixed-point solver, the analyses, statement views and linking."""
