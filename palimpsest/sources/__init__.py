"""Reading requests, documents and model output; writing results."""
