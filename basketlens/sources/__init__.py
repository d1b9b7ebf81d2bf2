"""Readers and writers: purchase logs, JSON exchange files, result and trial tables."""
