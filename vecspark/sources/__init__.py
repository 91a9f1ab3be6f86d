"""Reading and writing corpus tables, request bodies and request logs."""
