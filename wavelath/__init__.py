"""Packetised sample streams on Spark: packets, frames, spectra, smoothing, histograms, sinks and graphs."""
