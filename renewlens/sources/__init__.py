"""Reading and landing feeds, writing results, managing tables and views."""
