"""Relational operators: functions of DataFrames and parameters that declare a plan. Two look at the data first, as positions
need counts: ``sort.positions`` of a whole table and ``scan.page_scan``."""
