"""Sessions and the inspection of physical plans."""
