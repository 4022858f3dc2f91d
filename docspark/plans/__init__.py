"""What a conversion may do: formats, options and their errors, checked before anything is read."""
