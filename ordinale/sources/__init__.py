"""Reading tables as frames and writing results."""
