"""The log as a stream: flush by micro-batch, and the latest version of each key as state."""
