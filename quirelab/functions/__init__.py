"""Part of quirelab."""
