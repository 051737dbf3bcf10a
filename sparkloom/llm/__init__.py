"""Training-data operators: text quality, languages, secrets, licences, copies, packing."""
