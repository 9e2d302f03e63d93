"""Set-oriented operators over the catalog model."""
