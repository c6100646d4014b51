"""Relational operators over vector tables: search, sampling, quantization, clustering, tuning."""
