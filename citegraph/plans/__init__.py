"""End-to-end analyses built from the operators."""
