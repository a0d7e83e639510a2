"""Tables and files that the operators read and write."""
