"""Claims, knowledge and usage analytics as DataFrame jobs."""
