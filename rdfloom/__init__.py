"""rdfloom: audit of multilingual, aligned structured-data-to-text corpora on Spark.

The core never imports the subpackage ``llm``; that one builds on the core.
"""

__version__ = "0.1.0"
