"""Training-data operators: ten document-scale jobs, each one module, and their registered queries."""
