"""Column builders: parsing of text fields, lifecycle status, exact ratios, sort order."""
