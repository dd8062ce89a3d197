"""News and document curation as Spark DataFrame operators."""
