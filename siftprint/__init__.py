"""Content fingerprints and similarity search on Spark: digests, perceptual hashes, Hamming search."""

from .errors import InvalidInput, SiftprintError

__all__ = ["InvalidInput", "SiftprintError"]
