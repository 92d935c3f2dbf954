"""Functions on packets, integer samples and spectra."""
