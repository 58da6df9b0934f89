"""Operators for text corpora and record sets that feed language models. Nothing outside this folder imports it."""
