"""Part of siftmill; see README.md."""
