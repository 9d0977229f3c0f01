"""The modelling language: text to a checked model, and models to values."""
