"""Part of siftline; see README.md."""
