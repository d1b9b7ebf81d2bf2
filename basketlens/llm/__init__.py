"""Operators for building training corpora, each usable by itself; `queries` registers one query per operator."""
