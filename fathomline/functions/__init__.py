"""Part of fathomline; see README.md."""
