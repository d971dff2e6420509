"""Reading series from files and writing results."""
