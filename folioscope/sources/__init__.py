"""Where a corpus comes from: export files, their parsing, and reference tables."""
