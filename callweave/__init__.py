"""callweave: conversation-quality analytics expressed as Spark DataFrame plans."""
