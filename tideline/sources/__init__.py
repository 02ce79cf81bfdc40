"""Where logs come from: tables as logs, and object files."""
