"""Structural facts about compiled JVM code as Spark DataFrames, and operators over them.

The core (``operators``, ``functions``, ``sources``, ``plans``, ``streaming``) never imports ``factweave.llm``;
that subpackage holds the operators for language-model corpora and may be removed.
"""

__version__ = "0.1.0"
