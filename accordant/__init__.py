"""Annotation agreement on Spark.

Tables of texts with several human raters and one or more models go in;
agreement statistics, labelled tables and cost ledgers come out.  Everything is
a DataFrame job: raw rows are compressed once into counts of identical rating
rows, and each statistic is arithmetic on those counts.
"""

__version__ = "0.1.0"
