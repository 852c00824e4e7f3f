"""pagelens: analytics over stored web pages and crawl logs, as Spark DataFrame operators."""
