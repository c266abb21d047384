"""Graph, history and text analytics as DataFrame operators."""
