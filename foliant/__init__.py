"""foliant: document analytics and hybrid retrieval as Spark plans."""
