"""Pattern routing, event analytics and state operators as PySpark DataFrame functions."""
