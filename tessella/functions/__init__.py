"""Column functions on strings: names, logs, reports."""
