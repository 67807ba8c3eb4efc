"""Reading and writing of clips, labels, logs and reports."""
