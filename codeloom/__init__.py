"""codeloom: code corpora as relational data on Spark."""
