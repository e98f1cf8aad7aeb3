"""Relational building blocks over files, symbols, graphs, documents and ledgers."""
