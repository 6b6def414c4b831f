"""Training-data operators. Nothing outside this subpackage (but the registry and the pipeline) imports it."""
