"""Reading and writing delimited text."""
