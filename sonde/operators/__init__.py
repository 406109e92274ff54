"""DataFrame operators: BM25, rank fusion, chunking."""
