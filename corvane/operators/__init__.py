"""Retrieval, chunking, embedding, reranking, merges and batch drivers."""
