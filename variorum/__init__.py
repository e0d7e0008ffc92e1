"""variorum: textual collation and rule-based variant analysis on PySpark."""
