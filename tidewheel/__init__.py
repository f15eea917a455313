"""Event data on Spark: feeds, ledgers, directories, and (in llm) training text."""
