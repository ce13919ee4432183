"""Mathematical functions and distributions."""
