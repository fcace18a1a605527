"""Training-data operators: ten corpus operators and the pipeline that chains five of them."""
