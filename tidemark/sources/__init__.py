"""Reading events, declared tables and the offset store."""
