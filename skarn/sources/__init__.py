"""Tables and where they come from: files, databases, versioned tables, key-value tables."""
