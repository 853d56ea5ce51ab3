"""Subpackage of mnemora."""
