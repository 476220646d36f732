"""loam: document search and corpus analytics expressed as Spark plans."""
