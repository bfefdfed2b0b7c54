"""Time-aware document retrieval on Spark: sources, functions, operators, plans, streaming, clients."""

from corvane.config import Settings, settings
from corvane.operators.chunking import ChunkConfig, chunk_html, chunk_text, count_tokens
from corvane.operators.embedding import Embedder, HashEmbedder, RemoteEmbedder, embedder, write_back
from corvane.operators.rerank import Scorer, cross_encoder, register, rerank, scorer
from corvane.operators.retrieval import bm25, dense, fuse, lexical
from corvane.plans.hybrid import hybrid

__all__ = [
    "ChunkConfig", "Embedder", "HashEmbedder", "RemoteEmbedder", "Scorer", "Settings", "bm25", "chunk_html", "chunk_text", "count_tokens",
    "cross_encoder", "dense", "embedder", "fuse", "hybrid", "lexical", "register", "rerank", "scorer", "settings", "write_back",
]
