"""symdex: code-intelligence search and corpus analytics on Spark."""
