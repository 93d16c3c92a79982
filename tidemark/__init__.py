"""Point-in-time market analytics and corpus operators as Spark DataFrame functions."""
