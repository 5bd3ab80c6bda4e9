"""The four reports, composed from the operators."""
