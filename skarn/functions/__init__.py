"""User-defined functions, in batches through Arrow."""
