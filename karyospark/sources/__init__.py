"""Readers and writers of the file formats; parsing is DataFrame work, lines never reach Python."""
