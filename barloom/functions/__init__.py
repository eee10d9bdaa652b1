"""Part of barloom; see README.md."""
