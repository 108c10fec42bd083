"""From query text to DataFrame plans."""
