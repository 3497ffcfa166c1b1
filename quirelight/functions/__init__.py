"""Part of quirelight."""
