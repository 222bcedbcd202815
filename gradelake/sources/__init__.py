"""File readers and text models: the only places where Python meets rows."""
