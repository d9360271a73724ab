"""ravelin: a Spark-native engine for messy, semi-structured records.

Sub-packages
------------
functions   Column builders (text, dates, similarity)
sources     readers for JSON Lines, JSON documents, delimited text and SQLite
operators   ingest, index maintenance, search, aggregation, resolution, memory,
            timestamp normalisation, nested-record shredding, skew-proof statistics
plans       the registered queries and their oracle SQL
streaming   Structured Streaming versions of the maintenance operators
llm         operators on training text; optional, nothing else imports it
"""

__version__ = "0.1.0"
