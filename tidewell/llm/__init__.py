"""Training-data operators: ten stand-alone jobs and their queries."""
