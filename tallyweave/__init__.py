"""Plan-versus-actual analytics as Spark DataFrame plans."""
