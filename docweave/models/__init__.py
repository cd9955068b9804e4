"""Steps that a language model may take over; the default backend is deterministic and extractive."""
