"""Operators that prepare records for training language models; nothing outside this subpackage imports it."""
