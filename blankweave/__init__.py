"""blankweave: corpora of form documents as Spark tables.

Blank detection, field naming, record merging, bulk edits and fill
conversations, all expressed with the DataFrame, SQL and Structured
Streaming APIs.
"""

__version__ = "0.1.0"
