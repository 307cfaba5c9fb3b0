"""Relational operators over corpora, scores and run logs."""
