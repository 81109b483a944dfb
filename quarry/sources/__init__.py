"""Reading files and reading and writing collections."""
