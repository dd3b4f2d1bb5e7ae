"""Analytics on document corpora: DataFrame operators for cleaning, chunking, retrieval, routing and evaluation."""
