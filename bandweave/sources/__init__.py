"""Reading and writing: series files, word files, vectors, and the tables that stand in for them."""
