"""Matching purchase specifications against catalogs and price lists with Spark."""
