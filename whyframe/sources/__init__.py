"""Tables, row ids and logs."""
