"""Reading and writing the tables and files this library works with."""
