"""Operators for language-model corpora; the core never imports this subpackage."""
