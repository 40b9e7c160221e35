"""Column functions: text normalization, templates, labels, review JSON."""
