"""The same jobs fed by readStream."""
