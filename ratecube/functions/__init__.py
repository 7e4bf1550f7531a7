"""Column functions: code tables, recodes, null-propagating measures."""
