"""What an access asks for, and prepared queries."""
