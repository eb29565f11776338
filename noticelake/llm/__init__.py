"""Operators that prepare text corpora for training; nothing outside imports this subpackage."""
