"""Structured streaming over event tables; beyond the relational operators, for the same data as it arrives."""
