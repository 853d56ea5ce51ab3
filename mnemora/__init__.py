"""mnemora: conversational evidence retrieval and corpus preparation on Spark."""
