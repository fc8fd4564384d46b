"""State machines and their batch and streaming runners."""
