"""urlsieve: build, audit, featurise and score labelled URL corpora with Spark."""
