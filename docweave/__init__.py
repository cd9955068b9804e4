"""docweave: document-structure analytics on Spark.

Every operator is a ``DataFrame -> DataFrame`` transformation.  The operators
for large text corpora live in :mod:`docweave.llm`; nothing outside that
subpackage imports it.
"""

__version__ = "0.1.0"
