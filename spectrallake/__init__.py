"""Analytics of images, spectra and point sets on Spark DataFrames."""
