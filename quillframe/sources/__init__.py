"""Reading and writing packages, and the XML inside them."""
