"""Code-quality and text-corpus analytics as Spark DataFrame plans."""
