"""Image and event files: MRC, TIFF, EER, DigitalMicrograph and ZARR, as Spark data sources and sinks."""
