"""Panel results made of several operators over one filtered base."""
