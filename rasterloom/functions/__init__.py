"""Column functions: bit layouts of packed screen memory, colours and their distances."""
