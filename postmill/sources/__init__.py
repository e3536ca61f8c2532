"""Reading the corpus and the record tables, writing results."""
