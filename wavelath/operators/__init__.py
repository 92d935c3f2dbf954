"""Operators on streams of packets and frames, in batch."""
